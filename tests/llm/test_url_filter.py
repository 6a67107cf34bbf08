import itertools
import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from helixframe.llm import url_filter as U

URLS = [None, "", "example.com/en/", "http://", "http://Example.COM/en/x?y#z", "https://www.example.com/en/", "ftp://a.b.www.example.com/en/1", "http://notexample.com/en/", "http://x.net/es/1", "http://net/fr/", "http://x.net/fr", "http://x.net/Es/", "http://a.org?://com/", "http://com", "http://com/", "http://xcom/", "x://y://z.com/", "http://a.net#/es/", "http://É.Com/é\n/?", "http://thebig-dog24.org/cats/and.dogs"]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    raw = re.match("[^/?#]*", rest)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), raw)
    path = re.split("[?#]", rest[len(raw) :])[0]
    fit = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, None))
    return host, path, best[1], best[2]


def test_rules_match_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "The big dog and the cat", i) for i, u in enumerate(URLS * 2)] + [(None, None, None, 1)], "page_id long, url string, html string, score int")
    rows = U.judged(pages).collect()
    assert len(rows) == 2 * len(URLS) + 1
    for r in rows:
        host, path, rule, verdict = brute(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule), r
        assert r.verdict == (verdict or ("block" if r.score > 0 else "allow"))


def test_viterbi_is_the_cheapest_split():
    counts = {"the": 50, "big": 9, "dog": 9, "thebig": 1, "do": 3, "gs": 1, "dogs": 4}
    s = U.Segmenter(sum(counts.values()))
    cost = lambda p: math.log(s.total / counts[p]) if p in counts else s.unknown(len(p))
    counts["donaudampfschiffahrtsgesellschaft"] = 1
    for text in ("thebigdogs", "dogsdo", "xthe", "zz", "xxthexx"):
        got = s.viterbi(text, counts)
        assert "".join(got) == text
        assert math.isclose(sum(map(cost, got)), min(sum(map(cost, parts)) for parts in splits(text)))


def test_long_words_are_found():
    word = "donaudampfschiffahrtsgesellschaft"
    assert U.Segmenter(100).viterbi("the" + word + "q" * 60, {"the": 9, word: 1}) == ["the", word, "q" * 60]


def splits(text):
    for k in range(len(text)):
        for at in itertools.combinations(range(1, len(text)), k):
            yield [text[i:j] for i, j in zip((0, *at), (*at, len(text)))]


def brute_words(host, counts, total):
    cost = lambda p: math.log(total / counts[p]) if p in counts and len(p) > 1 else math.log(total or 1) + 2 + 2.5 * len(p)
    out = []
    for run in re.findall("[a-z]+|[0-9]+|[^a-z0-9_.-]+", host):
        out += min(splits(run), key=lambda parts: round(sum(map(cost, parts)), 9)) if "a" <= run[0] <= "z" else [run]
    return out


def test_words_verdicts_and_scores_match_brute_force(spark):
    """Words of hosts, Bayes counts, scores and verdicts, all of them from plain Python; rare words count like frequent ones."""
    rng = random.Random(4)
    vocab = ["big", "dog", "cat", "news", "shop", "rare", "best", "deal"]
    text = " ".join(rng.choice(vocab[:5]) for _ in range(300)) + " rare Best deal"
    rows = []
    for i in range(80):
        end = rng.choice([".com", ".net", ".org", ".org"])
        some = {".com": vocab[:4], ".net": vocab[4:], ".org": vocab[4 * (i % 2) :][:4]}[end]
        host = rng.choice(["", "www.", "m."]) + "".join(rng.sample(some, 2)) + rng.choice(["", "-7", "9"]) + end
        rows.append((i, f"http://{host}/{rng.choice(['es', 'es', 'en', 'fr'])}/{rng.choice(some)}_{rng.choice(some)}.Html?q", text if i == 0 else None))
    rows += [(100, None, None), (101, "x", None), (102, rows[0][1], None), (102, rows[0][1], None)]
    counts = Counter(re.findall("[a-z]{2,}", text.lower()))
    total = sum(counts.values())
    tokens = lambda h, p: ["h" + w for w in brute_words(h, counts, total)] + ["p" + w for w in re.split("[/._=&+%~,;:!-]+", p.lower()) if w]
    seen, n = {"block": Counter(), "allow": Counter()}, Counter()
    for _, url, _ in rows:
        host, path, _, verdict = brute(url)
        if verdict:
            n[verdict] += 1
            seen[verdict].update(zlib.crc32(w.encode()) % U.BUCKETS for w in tokens(host, path))
    share = lambda v, b: math.log((seen[v][b] + 1) / (sum(seen[v].values()) + U.BUCKETS))
    got = U.judged(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert len(got) == len(rows)
    free = Counter()
    for r in got:
        host, path, rule, verdict = brute(r.url)
        want = math.log((n["block"] + 1) / (n["allow"] + 1)) + sum(share("block", b) - share("allow", b) for b in (zlib.crc32(w.encode()) % U.BUCKETS for w in tokens(host, path)))
        assert math.isclose(r.score, want, abs_tol=1e-4), (r, want)
        if abs(want) > 1e-3:
            assert r.verdict == (verdict or ("block" if want > 0 else "allow"))
            free[r.verdict] += verdict is None
    assert free["block"] and free["allow"]


def test_a_word_of_any_rarity_and_a_very_long_label(spark):
    """100,000 words are more frequent than the one that a host is made of."""
    common = " ".join(f"{a}{b}{c}x" for a in "abcdefghij" for b in map(chr, range(97, 123)) for c in map(chr, range(97, 123))) + " "
    pages = spark.createDataFrame([(0, "http://zebraquagga.org/", common * 3 + "zebra quagga"), (1, "http://" + "y" * 5000 + ".org/", None)], "page_id long, url string, html string")
    hosts = U.host_words(pages.select(U.host_of(F.col("url")).alias("host")), U.unigrams(pages))
    got = {r.host: r.words for r in hosts.collect()}
    assert got["zebraquagga.org"] == ["zebra", "quagga", "org"] and "".join(got["y" * 5000 + ".org"]) == "y" * 5000 + "org"


def test_bayes_learns_from_ruled_pages(spark):
    rows = [(i, f"http://{'good' if i % 2 else 'nasty'}{i}.{'com' if i % 2 else 'net'}/{'' if i % 2 else 'es/'}{'news' if i % 2 else 'junk'}", "good nasty words") for i in range(60)]
    rows += [(100, "http://nasty.org/junk", ""), (101, "http://good.org/news", "")]
    got = {r.page_id: r.verdict for r in U.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[100] == "block" and got[101] == "allow"


def test_empty_table(spark):
    assert U.judged(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
