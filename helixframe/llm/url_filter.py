"""URL filters: rules first, then naive Bayes over the words of host and path.

Rules name a host (with its subdomains) and the beginning of a path; the longest that fits decides. Where none fits, a multinomial naive Bayes model
does. Its tokens are the path's words and the words that host names are run together from, which a Viterbi search
splits off by unigram costs. Unigrams are counted over all pages' texts, and those that are substrings of a host meet it by joins; none are left out.
Bayes counts come from all pages that a rule decides, added up by hashed token (``BUCKETS``) and verdict before
they reach the driver; the odds, one number a bucket, are broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, in_batches, stored, table

#: Verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
BUCKETS = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null and without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null and without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)), F.lit(""))


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host`` + ``path``, and its verdict; else null. Of equal rules, the first holds."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


class Segmenter:
    """Splits a run of letters into the likeliest words: a word costs the negative logarithm of its share of ``total``."""

    def __init__(self, total: int):
        self.total = total or 1
        # An unknown word costs more than the rarest known one, and more with each letter.
        self.first, self.letter = math.log(self.total) + 2, 2.5

    def unknown(self, n: int) -> float:
        return self.first + self.letter * n

    def viterbi(self, text: str, counts: dict[str, int]) -> list[str]:
        """counts: how often each substring that is a word occurs. Of equally likely splits, the one with the longest last word.

        Words have any length. Known ones are tried by the lengths that there are; an unknown one costs the same for each letter, so its best begin is carried along.
        """
        n = len(text)
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        cost = {w: math.log(self.total / c) for w, c in counts.items()}
        lengths = sorted({len(w) for w in cost}, reverse=True)
        begin = 0  # of the cheapest unknown word that ends here, less what its letters cost
        for j in range(1, n + 1):
            if best[j - 1] - self.letter * (j - 1) < best[begin] - self.letter * begin - 1e-9:
                begin = j - 1
            best[j], back[j] = best[begin] + self.unknown(j - begin), begin
            for k in lengths:
                if k <= j and (c := cost.get(text[j - k : j])) is not None:
                    c += best[j - k]
                    if c < best[j] or (c == best[j] and j - k < back[j]):
                        best[j], back[j] = c, j - k
        out = []
        while n:
            out.append(text[back[n] : n])
            n = back[n]
        return out[::-1]


def unigrams(pages: DataFrame, text_col: str = "html") -> DataFrame:
    """(w, n): how often each word of two or more letters a-z stands in the texts, A-Z lower-cased."""
    words = F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), UPPER, LOWER), F.lit("[a-z]{2,}"), F.lit(0))
    return pages.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


def _pieces(text: Column) -> Column:
    """Runs of letters, of digits, and of other characters but hyphens and underscores."""
    return F.regexp_extract_all(text, F.lit("[a-z]+|[0-9]+|[^a-z0-9_.-]+"), F.lit(0))


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, words): each distinct host's labels split into words, in order; from (host) and the unigrams (w, n).

    Every substring of a distinct run of letters that has some unigram's length is joined with the counts, so that all words count, however rare or long, and no vocabulary is held anywhere; a
    task holds one run's own words. The joins are on substrings and on runs, and texts are not in them.
    """
    counts = stored(counts, "unigrams")
    total = counts.agg(F.sum("n")).first()[0] or 0
    at = stored(hosts.select("host", F.posexplode(_pieces(F.col("host"))).alias("at", "run")), "runs")
    runs = at.select("run").filter(F.col("run").rlike("^[a-z]")).distinct()
    # Lengths that both a unigram and a run can have: at most as many as the longest host has letters.
    longest = runs.agg(F.max(F.length("run"))).first()[0] or 0
    sizes = sorted(r[0] for r in counts.filter(F.length("w") <= longest).select(F.length("w")).distinct().collect())
    by_size = runs.select("run", F.explode(F.lit(sizes).cast("array<int>")).alias("k")).filter(F.col("k") <= F.length("run"))
    # Slices of the letters, which are split once: a substring would count its way from the run's start.
    every = lambda letters: F.transform(F.sequence(F.lit(1), F.length("run") - F.col("k") + 1), lambda i: F.array_join(F.slice(letters, i, F.col("k")), ""))
    subs = F.get(F.transform(F.array(F.split("run", "")), every), F.lit(0))
    known = by_size.select("run", F.explode(F.array_distinct(subs)).alias("w")).join(counts, "w").groupBy("run").agg(F.collect_list(F.struct("w", "n")).alias("known"))
    segmenter = Segmenter(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [segmenter.viterbi(text, {x["w"]: x["n"] for x in own or []}) for text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["run", "words"])

    split = stored(in_batches(runs.join(known, "run", "left")).select("run", "known").mapInArrow(run, "run string, words array<string>"), "splits")
    joined = at.join(split, "run", "left").select("host", "at", F.coalesce("words", F.array("run")).alias("words"))
    found = joined.groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("words"))
    return stored(hosts.join(found, "host", "left").select("host", F.coalesce("words", F.array().cast("array<string>")).alias("words")), "hosts")


def _buckets(words: Column, kind: str) -> Column:
    return F.transform(words, lambda w: (F.crc32(F.concat(F.lit(kind), w).cast("binary")) % BUCKETS).cast("int"))


def path_words(path: Column) -> Column:
    return F.filter(F.split(F.lower(path), "[/._=&+%~,;:!-]+"), lambda w: w != "")


def bayes(known: DataFrame, hosts: DataFrame) -> tuple[np.ndarray, float]:
    """Log odds of block against allow for each bucket, and the prior's, from (host, path, verdict) with add-one smoothing.

    Host tokens are counted by host and verdict first, so a host of many pages is one row where words are joined.
    """
    of_hosts = known.groupBy("host", "verdict").agg(F.count("*").alias("n"))
    named = of_hosts.join(hosts, "host").select("verdict", F.explode(_buckets(F.col("words"), "h")).alias("bucket"), "n")
    named = named.union(known.select("verdict", F.explode(_buckets(path_words(F.col("path")), "p")).alias("bucket"), F.lit(1).cast("long").alias("n")))
    count = np.zeros((2, BUCKETS))
    for r in named.groupBy("bucket", "verdict").agg(F.sum("n").alias("n")).collect():  # 2 * BUCKETS rows at most
        count[int(r.verdict == "block"), r.bucket] = r.n
    rows = {r.verdict: r.n for r in of_hosts.groupBy("verdict").agg(F.sum("n").alias("n")).collect()}
    share = np.log(count + 1) - np.log(count.sum(1, keepdims=True) + BUCKETS)
    return (share[1] - share[0]).astype(np.float32), math.log((rows.get("block", 0) + 1) / (rows.get("allow", 0) + 1))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, url_col: str = "url", text_col: str = "html", texts: DataFrame | None = None) -> DataFrame:
    """The rows of pages with host, path, rule (null: none fits), score (log odds of block by naive Bayes) and verdict.

    Unigrams come from ``text_col`` of ``texts`` (default: of pages itself). Without a fitting rule, block needs a score above zero. Null urls have an empty host and path, and so
    the prior's score; null texts add no words. Of equally long rules the first holds.
    Repeated rows get a row each, an empty table none; columns of pages with the result's names are replaced.
    """
    results = ["host", "path", "rule", "score", "verdict"]
    keep = [c for c in pages.columns if c not in results]
    host_, path_, rule_, verdict_, words_, tokens_ = fresh(pages, "__host", "__path", "__rule", "__verdict", "__words", "__tokens")
    urls = in_batches(pages).select(*keep, host_of(F.col(url_col).cast("string")).alias(host_), path_of(F.col(url_col).cast("string")).alias(path_))
    name, verdict = ruled(F.col(host_), F.col(path_), rules)
    urls = urls.withColumns({rule_: name, verdict_: verdict})
    hosts = host_words(urls.select(F.col(host_).alias("host")).distinct(), unigrams(pages if texts is None else texts, text_col))
    known = urls.filter(F.col(verdict_).isNotNull()).select(F.col(host_).alias("host"), F.col(path_).alias("path"), F.col(verdict_).alias("verdict"))
    held = pages.sparkSession.sparkContext.broadcast(bayes(known, hosts))
    tokens = F.concat(_buckets(F.col(words_), "h"), _buckets(path_words(F.col(path_)), "p"))
    # Hosts are a stored table: Spark broadcasts it where its size allows, else a host of many pages can be split.
    met = urls.join(hosts.select(F.col("host").alias(host_), F.col("words").alias(words_)), host_).select(*keep, host_, path_, rule_, verdict_, tokens.alias(tokens_))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds, prior = held.value
        for batch in batches:
            verdicts, lists = batch.column(len(keep) + 3).to_pylist(), batch.column(len(keep) + 4).to_pylist()
            scores = [prior + float(odds[own].sum()) if own else prior for own in lists]
            final = [v or ("block" if s > 0 else "allow") for v, s in zip(verdicts, scores)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep) + 3], pa.array(scores, pa.float64()), pa.array(final, pa.string())], [*keep, *results])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema] + ["host string, path string, rule string, score double, verdict string"])
    return met.mapInArrow(run, schema)


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every page; null urls have an empty host and path."""
    pages = table(spark, sf_dir, "pages")
    return judged(pages.select("page_id", "url"), texts=pages.select("html")).select("page_id", "host", "path", "rule", "verdict", "score")
