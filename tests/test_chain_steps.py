from helixframe.operators import chaining as C


def test_single_links_are_found_without_comparing_all_ends(monkeypatch):
    """Where a link is the only one of its ends, no pair of links is looked for, and ends are compared in the step itself."""
    calls = [0]
    faces = C.faces
    monkeypatch.setattr(C, "faces", lambda *a: calls.__setitem__(0, calls[0] + 1) or faces(*a))
    ends = {v: {0: C.End(v, 0, str(v), 100, 1), 1: C.End(v, 1, str(v + 1), 20, -1)} for v in range(30)}
    found = C.Cluster(ends, dict.fromkeys(ends, 1.0)).resolve()
    assert [len(c.steps) for c in found] == [30] and set(found[0].rules) == {"ONLY"} and calls[0] == 0
