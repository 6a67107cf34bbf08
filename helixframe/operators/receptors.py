"""Immune receptors, HLA alleles, pharmacogenes and peptides: anchors, annotation, alleles, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the anchor score: per amino acid and in all.
PER_RESIDUE, CONSTANT = 3, 6
SHORTEST, LONGEST = 5, 40
UNMUTATED, BORDERLINE = 98.0, 97.0


def substitution_matrix(spark: SparkSession, path: str) -> dict[str, dict[str, int]]:
    """Scores of a matrix file: comment lines, a header of letters, then a line for each letter. Twenty-odd lines reach the driver."""
    lines = [r.value.split() for r in spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != "")).collect()]
    return {row[0]: dict(zip(lines[0], map(int, row[1:]))) for row in lines[1:]}


def _pairs(matrix: dict[str, dict[str, int]]) -> Column:
    return F.create_map(*[F.lit(x) for a, row in matrix.items() for b, v in row.items() for x in (a + b, v)])


def similarity(reference: Column, query: Column, matrix: dict[str, dict[str, int]]) -> Column:
    """3 n - 6 - sum M(ref, ref) + sum M(ref, query) over two sequences of n amino acids; null for other lengths or letters."""
    table = _pairs(matrix)
    both = F.zip_with(F.split(reference, ""), F.split(query, ""), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    both = F.filter(both, lambda x: (x["a"] != "") | (x["b"] != ""))
    gain = lambda x: F.try_element_at(table, F.concat(x["a"], x["b"])) - F.try_element_at(table, F.concat(x["a"], x["a"]))
    total = F.aggregate(F.transform(both, gain), F.lit(0), lambda s, x: s + x)
    return F.when(F.length(reference) == F.length(query), PER_RESIDUE * F.length(reference) - CONSTANT + total)


def best_anchor(sequences: DataFrame, anchors: DataFrame, matrix: dict[str, dict[str, int]], width: int) -> DataFrame:
    """(id, anchor, at, score) of the best window of ``width`` amino acids of each sequence (id, sequence) against the known anchors (anchor), if its score is positive; ties by place, then anchor.

    Windows are scored by distinct window first, so each is compared with the anchors (some hundred, broadcast) once.
    """
    from ..functions.sequences import kmers

    windows = sequences.select("id", F.posexplode(kmers(F.col("sequence"), width)).alias("at", "window"))
    scored = windows.select("window").distinct().join(F.broadcast(anchors.filter(F.length("anchor") == width).distinct()), F.lit(True))
    scored = scored.withColumn("score", similarity(F.col("anchor"), F.col("window"), matrix)).filter("score > 0")
    top = scored.groupBy("window").agg(F.min(F.struct((-F.col("score")).alias("s"), "anchor")).alias("b"))
    met = windows.join(top, "window").groupBy("id").agg(F.min(F.struct(F.col("b.s").alias("s"), "at", F.col("b.anchor").alias("anchor"))).alias("b"))
    return met.select("id", "b.anchor", "b.at", (-F.col("b.s")).alias("score"))


def receptor_filters(sequences: DataFrame, *ties: str) -> DataFrame:
    """Sequences (locus, cdr3, support, v, j, v_end, j_start, deleted, reference, supported) with ``filters`` joined by ``;``, or PASS. Of equal CDR3 sequences of a locus all but the one of most support (ties by id, then the columns given) are duplicates."""
    c = F.col
    order = Window.partitionBy("locus", "cdr3").orderBy(F.desc("support"), "id", *ties)
    n = F.length("cdr3") / 3
    tests = {
        "PARTIAL": ~(c("v") & c("j")), "DUPLICATE": (F.row_number().over(order) > 1) & (c("cdr3") != ""), "CDR3_DELETED": c("deleted"), "MAX_LENGTH": n >= LONGEST, "MIN_LENGTH": n < SHORTEST,
        "MATCHES_REF": c("reference"), "NO_HIGH_QUAL_SUPPORT": ~c("supported"), "V_J_OVERLAP": c("v") & c("j") & (c("j_start") < c("v_end")),
    }
    found = F.array_compact(F.array(*[F.when(t, x) for x, t in tests.items()]))
    return sequences.withColumn("filters", F.when(F.size(found) == 0, "PASS").otherwise(F.array_join(found, ";")))


def hypermutation(identity: Column) -> Column:
    """Status from the percentage of equal bases."""
    return F.when(identity >= UNMUTATED, "UNMUTATED").when(identity >= BORDERLINE, "MUTATED_BORDERLINE").otherwise("MUTATED")


def locus_summary(reads: DataFrame, sequences: DataFrame, most: int) -> DataFrame:
    """(locus, reads_used, reads_total, down_sampled, sequences, pass_sequences)."""
    r = reads.groupBy("locus").agg(F.count_if("used").alias("reads_used"), F.count("*").alias("reads_total"), (F.count("*") > most).alias("down_sampled"))
    s = sequences.groupBy("locus").agg(F.count("*").alias("sequences"), F.count_if(F.col("filters") == "PASS").alias("pass_sequences"))
    return r.join(s, "locus", "left").fillna(0, ["sequences", "pass_sequences"])


def locus_evidence(fragments: DataFrame, least: float, share: float) -> DataFrame:
    """(gene, locus, letter, n) of letters at a gene's place with at least ``least`` fragments and ``share`` of the place's; fragments: (gene, fragment, locus, letter, high), where only high-quality ones count towards the limits and a fragment counts once."""
    each = fragments.groupBy("gene", "locus", "letter", "fragment").agg(F.bool_or("high").alias("h")).groupBy("gene", "locus", "letter").agg(F.count_if("h").alias("n"))
    total = each.groupBy("gene", "locus").agg(F.sum("n").alias("t"))
    return each.join(total, ["gene", "locus"]).filter((F.col("n") >= F.greatest(F.lit(float(least)), share * F.col("t"))) & (F.col("n") > 0)).select("gene", "locus", "letter", "n")


def surviving_alleles(alleles: DataFrame, evidence: DataFrame) -> DataFrame:
    """Alleles (allele, gene) whose letter at every place with more than one supported letter is among the supported ones; alleles: (allele, gene, locus, letter), ``*`` matches any."""
    places = evidence.groupBy("gene", "locus").agg(F.collect_set("letter").alias("letters")).filter(F.size("letters") > 1)
    wrong = alleles.join(places, ["gene", "locus"]).filter((F.col("letter") != "*") & ~F.array_contains("letters", F.col("letter"))).select("allele", "gene").distinct()
    return alleles.select("allele", "gene").distinct().join(wrong, ["allele", "gene"], "left_anti")


def compared_types(old: DataFrame, new: DataFrame, sample: str) -> DataFrame:
    """(sample, gene, status): MATCH where both sources have the same alleles of a gene (repeats count), PARTIAL where they share some, else DIFF."""
    listed = lambda df, name: df.groupBy(sample, "gene").agg(F.array_sort(F.collect_list("allele")).alias(name))
    both = listed(old, "__o").join(listed(new, "__n"), [sample, "gene"], "full_outer")
    none = F.array().cast("array<string>")
    o, n = F.coalesce("__o", none), F.coalesce("__n", none)
    return both.select(sample, "gene", F.when(o == n, "MATCH").when(F.arrays_overlap(o, n), "PARTIAL").otherwise("DIFF").alias("status"))


def allele_copies(support: DataFrame, genes: DataFrame) -> DataFrame:
    """(sample, gene, allele, copies) of two alleles (sample, gene, allele, tumor, normal): the one with the lesser ratio of tumor to normal fragments has the gene's minor copy number, the other the rest; ties by allele. A homozygous gene has one row, with the minor one for one copy and the rest for the other under the names of both.

    genes: (sample, gene, min_cn, minor).
    """
    order = Window.partitionBy("sample", "gene").orderBy(F.when(F.col("normal") > 0, F.col("tumor") / F.col("normal")).otherwise(0.0), "allele")
    ranked = support.withColumn("__n", F.row_number().over(order)).join(genes, ["sample", "gene"])
    return ranked.select("sample", "gene", "allele", F.when(F.col("__n") == 1, F.col("minor")).otherwise(F.col("min_cn") - F.col("minor")).alias("copies"))


def somatic_alleles(fragments: DataFrame) -> DataFrame:
    """(variant, allele, weight): the allele that most of a variant's fragments (variant, fragment, allele) match; equal ones share the weight. A fragment that matches k alleles gives each 1 / k."""
    own = Window.partitionBy("variant", "fragment")
    each = fragments.withColumn("__w", 1 / F.count("*").over(own)).groupBy("variant", "allele").agg(F.sum("__w").alias("__w"))
    best = each.withColumn("__m", F.max("__w").over(Window.partitionBy("variant"))).filter("__w >= __m - 1e-9")
    return best.select("variant", "allele", (1 / F.count("*").over(Window.partitionBy("variant"))).alias("weight"))


def haplotype_events(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(sample, gene, haplotypes, function, qc) of calls (sample, gene, haplotype, copies): names with their copies in order, the worst function (order of severity in functions: haplotype, gene, function, severity), and the status: PASS with two copies in all, else WARN, UNKNOWN without a known haplotype."""
    named = calls.join(functions, ["gene", "haplotype"], "left")
    out = named.groupBy("sample", "gene").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat("haplotype", F.lit("_x"), F.col("copies").cast("string")))), ";").alias("haplotypes"), F.max_by("function", F.struct("severity", "function")).alias("function"), F.sum("copies").alias("__n"),
    )
    return out.select("sample", "gene", "haplotypes", F.coalesce("function", F.lit("Unknown")).alias("function"), F.when(F.col("function").isNull(), "UNKNOWN").when(F.col("__n") == 2, "PASS").otherwise("WARN").alias("qc"))


def peptide_scores(peptides: DataFrame, weights: DataFrame) -> DataFrame:
    """(allele, peptide, score): the sum over a peptide's places of the allele's weight for its length, place (from 0) and residue; a residue without a weight counts 0."""
    letters = peptides.select("allele", "peptide", F.length("peptide").alias("length"), F.posexplode(F.filter(F.split("peptide", ""), lambda x: x != "")).alias("position", "residue"))
    return letters.join(weights, ["allele", "length", "position", "residue"], "left").groupBy("allele", "peptide").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("score"))


def score_ranks(scores: DataFrame, random: DataFrame, by: list[str], steps: int = 100) -> DataFrame:
    """The scores with ``rank``: the share of random peptides' scores (by, score) that are higher, from their percentile vector; 0 is the best."""
    from .cohort import percentile_rank, percentile_vectors

    vectors = percentile_vectors(random, by, "score", steps).select(*by, "percentiles")
    return scores.join(vectors, by, "left").withColumn("rank", 1 - percentile_rank(F.col("percentiles"), F.col("score"))).drop("percentiles")


def presentation(rank: Column, tpm: Column, length_density: Column, half: float = 1.0) -> Column:
    """Likelihood of presentation: that of the rank within its length, times how much of the gene is expressed."""
    return length_density * (1 - rank) * tpm / (tpm + half)


def scored_epitopes(peptides: DataFrame, ranks: DataFrame, expression: DataFrame, medians: DataFrame) -> DataFrame:
    """(peptide, allele, gene, rank, tpm, ratio): peptides (peptide, allele, gene) with their rank, the sample's tpm of the gene or, without it, the cohort's median, and the ratio to that median."""
    out = peptides.join(ranks, ["peptide", "allele"], "left").join(expression, "gene", "left").join(medians, "gene", "left")
    tpm = F.coalesce("tpm", "median")
    return out.select("peptide", "allele", "gene", "rank", tpm.alias("tpm"), F.when(F.col("median") > 0, tpm / F.col("median")).alias("ratio"))


def flank_score(up: Column, down: Column, weights: dict[tuple[str, int, str], float]) -> Column:
    """The sum of the weights of the residues on both sides by side, distance (from 1) and residue; missing ones count 0."""
    table = F.create_map(*[F.lit(x) for (side, at, residue), w in weights.items() for x in (f"{side}{at}{residue}", float(w))]) if weights else F.create_map(F.lit(""), F.lit(0.0))
    part = lambda s, side: F.aggregate(F.transform(F.filter(F.split(s, ""), lambda x: x != ""), lambda x, i: F.coalesce(F.try_element_at(table, F.concat(F.lit(side), (i + 1).cast("string"), x)), F.lit(0.0))), F.lit(0.0), lambda t, x: t + x)
    return part(F.reverse(up), "U") + part(down, "D")


def nearest_known(peptides: DataFrame, known: DataFrame, matrix: dict[str, dict[str, int]], most: int = 2) -> DataFrame:
    """(peptide, known, differences, score): for each peptide the known one of its length that differs in at most ``most`` places with the highest substitution score, ties by differences and name.

    With d differences two of ``most`` + 2 parts at least are equal, so peptides meet by length and pairs of parts and are never all compared.
    """
    from ..functions.sequences import hamming_within

    def parts(name: str) -> Column:
        n, many = F.length(name), most + 2
        cut = [F.floor(n * i / many).cast("int") for i in range(many + 1)]
        part = [F.substring(F.col(name), cut[i] + 1, cut[i + 1] - cut[i]) for i in range(many)]
        return F.explode(F.array(*[F.struct(n.alias("n"), F.lit(i * many + j).alias("i"), part[i].alias("t"), part[j].alias("u")) for i in range(many) for j in range(i + 1, many)]))

    a = peptides.select("peptide").distinct().select("peptide", parts("peptide").alias("k"))
    b = known.select("known").distinct().select("known", parts("known").alias("k"))
    pairs = a.join(b, "k").select("peptide", "known").distinct().filter(hamming_within(F.col("peptide"), F.col("known"), most))
    differing = F.aggregate(F.zip_with(F.split("peptide", ""), F.split("known", ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    scored = pairs.withColumns({"differences": differing, "score": similarity(F.col("known"), F.col("peptide"), matrix)})
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("differences").alias("d"), F.col("known").alias("k"))).alias("b")
    return scored.groupBy("peptide").agg(best).select("peptide", F.col("b.k").alias("known"), F.col("b.d").alias("differences"), (-F.col("b.s")).alias("score"))


def true_positive_rates(ranks: DataFrame, by: list[str], cuts: list[float]) -> DataFrame:
    """(by, n, tpr_<i>): the share of binders whose rank is at or under each cut."""
    return ranks.groupBy(*by).agg(F.count("*").alias("n"), *[(F.count_if(F.col("rank") <= x) / F.count("*")).alias(f"tpr_{i}") for i, x in enumerate(cuts)])
