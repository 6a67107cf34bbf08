import itertools
import random
import re

from helixframe.llm import license_scan as L

RULES = L.rules()


def strings(pattern):
    """Every string of a pattern, but that repeats stop at two more than their least and word characters and digits are one each."""

    def of(parts):
        out = [""]
        for op, arg in parts:
            name = str(op)
            if name == "LITERAL":
                some = [chr(arg)]
            elif name == "IN":
                some = [chr(v) if str(o) == "LITERAL" else "7" for o, v in arg]
                for o, v in arg:
                    if str(o) == "RANGE":
                        some += [chr(v[0]), chr(v[1])]
            elif name == "BRANCH":
                some = [x for b in arg[1] for x in of(b)]
            elif name == "SUBPATTERN":
                some = of(arg[3])
            elif name == "MAX_REPEAT":
                one = of(arg[2])
                some = [x for n in range(arg[0], min(arg[0] + 2, arg[1]) + 1) for x in map("".join, itertools.product(one, repeat=n))]
            else:
                assert name == "ASSERT_NOT", name
                some = [""]
            out = [a + b for a in out for b in dict.fromkeys(some)]
        return out

    return of(re._parser.parse(pattern))


def test_every_string_of_a_pattern_has_its_keyword():
    bad = {(r[3], s) for r in RULES for s in strings(r[4]) if r[3] not in f" {s} "}
    assert not bad, sorted(bad)[:20]


def test_scan_matches_plain_regexes_without_the_prefilter(spark):
    rng = random.Random(9)
    texts = ["See the License for the specific language", "see licence", "See the licence.", "Released under the GNU Public License", "Beer-Ware License", "beerware license", "under a Responsible AI License", "RAIL license", "This license governs use of the accompanying software", "Vim is Charityware"]
    texts += [f"Foo {s} bar" for r in RULES for s in rng.sample(strings(r[4]), min(2, len(strings(r[4]))))]
    got = {r.text: {(d.label, d.first, d.end) for d in r.detections} for r in L.scan(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    for t in texts:
        form = " " + " ".join(re.findall("[0-9a-z]+", t.lower())) + " "
        found = sorted((m.start(), -m.end(), r[1], i) for i, r in enumerate(RULES) for m in re.finditer(f" (?:{r[4]})(?= )", form, re.ASCII))
        ends, want = [-1] * 4, set()
        for a, z, p, i in found:
            if max(ends[: p + 1]) < -z or RULES[i][2]:
                want.add((RULES[i][0], form[:a].count(" "), form[:-z].count(" ")))
            ends[p] = max(ends[p], -z)
        assert want == got[t], (t, want, got[t])
    assert [sorted(x[0] for x in got[t]) for t in texts[:10]] == [["see-license"], ["see-license"], ["see-license"], ["gpl"], ["beerware"], ["beerware"], ["openrail"], ["openrail"], ["ms-pl"], ["vim"]]
