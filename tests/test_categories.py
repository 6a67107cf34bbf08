"""Keys, fields and limits of comparison categories, written down from what each tool compares and not from the table."""

import pytest

from helixframe.operators.diff import CATEGORIES

WANT = {
    "purity": (
        {"SampleId"},
        {"qcStatus", "gender", "germlineAberration", "fitMethod", "msStatus", "tmbStatus", "tmlStatus"},
        {"purity": (0.04, None), "ploidy": (0.1, None), "contamination": (0.005, None), "tmbPerMb": (0.1, 0.05), "msIndelsPerMb": (0.1, 0.05), "tml": (1, 0.05), "copyNumberSegments": (5, 0.2), "unsupportedCopyNumberSegments": (5, 0.2), "svTmb": (5, 0.05), "tincLevel": (0.1, None)},
    ),
    "driver": ({"SampleId", "GeneId", "TranscriptId", "DriverType"}, {"likelihoodMethod", "chromosome", "chromosomeBand"}, {"driverLikelihood": (0.1, None), "minCopyNumber": (0.3, 0.15), "maxCopyNumber": (0.3, 0.15)}),
    "fusion": (
        {"SampleId", "FusionName"},
        {"reported", "reportedType", "phased", "likelihood", "fusedExonUp", "fusedTranscriptUp", "fusedExonDown", "fusedTranscriptDown", "chainLinks", "chainTerminated", "domainsKept", "domainsLost"},
        {"junctionCopyNumber": (0.5, 0.2)},
    ),
    "virus": ({"SampleId", "Name"}, {"reported", "driverLikelihood"}, {"integrations": (None, 0.2), "meanCoverage": (None, 0.15)}),
    "hr_deficiency": ({"SampleId"}, {"status", "type"}, {"BRCA1": (0.1, None), "BRCA2": (0.1, None), "hrdScore": (0.1, None)}),
}


@pytest.mark.parametrize("name", sorted(WANT))
def test_category(name):
    keys, fields = CATEGORIES[name]
    want_keys, equal, limits = WANT[name]
    assert set(keys) == want_keys and len(fields) == len(equal) + len(limits)
    for f in fields:
        absolute, relative = f.absolute or None, f.relative or None
        assert (f.name in equal and absolute is relative is None) or limits[f.name] == (absolute, relative)
