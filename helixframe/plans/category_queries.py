"""One comparison of two sources for each category: customers stand for samples; a tenth is missing on either side, and the second source's numbers and texts differ here and there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff as D
from ..storage import table
from .registry import query


def _numeric(field: D.Field) -> bool:
    return field.absolute is not None or field.relative is not None


def _sql(category: str) -> str:
    """The comparison written out for DuckDB, field by field."""
    keys, fields = D.CATEGORIES[category]
    columns = [f"CASE WHEN {j} = 0 THEN 'S' || c_custkey ELSE 'k' || (c_custkey % {j + 3}) END AS \"{k}\"" for j, k in enumerate(keys)]
    old, new = list(columns), list(columns)
    tests = []
    for j, f in enumerate(fields):
        if _numeric(f):
            value = f"((c_custkey * {j + 3}) % 97) / 7.0::DOUBLE"
            old.append(f'{value} AS "o_{f.name}"')
            new.append(f'{value} * (1 + ((c_custkey + {j}) % 5) * 0.06) + ((c_custkey + {j}) % 7) * 0.11 AS "n_{f.name}"')
            a, b = f'"o_{f.name}"', f'"n_{f.name}"'
            limits = [f"abs({a} - {b}) > {f.absolute}"] if f.absolute is not None else []
            limits += [f"abs({a} - {b}) / greatest(abs({a}), abs({b})) > {f.relative}"] if f.relative is not None else []
            tests.append(f"CASE WHEN NOT ({a} = 0 AND {b} = 0) AND {' AND '.join(limits)} THEN '{f.name}' END")
        else:
            old.append(f"'t' || (c_custkey % {j + 2}) AS \"o_{f.name}\"")
            new.append(f"'t' || ((c_custkey + CASE WHEN (c_custkey + {j}) % 11 = 0 THEN 1 ELSE 0 END) % {j + 2}) AS \"n_{f.name}\"")
            tests.append(f"CASE WHEN \"o_{f.name}\" <> \"n_{f.name}\" THEN '{f.name}' END")
    names = ", ".join(f'"{k}"' for k in keys)
    return f"""WITH a AS (SELECT {", ".join(old)}, true AS a FROM customer WHERE c_custkey % 10 <> 0), b AS (SELECT {", ".join(new)}, true AS b FROM customer WHERE c_custkey % 10 <> 1),
j AS (SELECT *, CASE WHEN a IS NULL OR b IS NULL THEN '' ELSE array_to_string(list_filter([{", ".join(tests)}], lambda x: x IS NOT NULL), ';') END AS fields FROM a FULL JOIN b USING ({names}))
SELECT {names}, CASE WHEN b IS NULL THEN 'OLD_ONLY' WHEN a IS NULL THEN 'NEW_ONLY' ELSE 'VALUE' END AS mismatch, fields FROM j WHERE a IS NULL OR b IS NULL OR fields <> ''"""


def _compare(category: str):
    keys, fields = D.CATEGORIES[category]

    def run(spark, sf_dir):
        k = F.col("c_custkey")
        c = table(spark, sf_dir, "customer")
        named = [(F.concat(F.lit("S"), k.cast("string")) if j == 0 else F.concat(F.lit("k"), (k % (j + 3)).cast("string"))).alias(name) for j, name in enumerate(keys)]
        old, new = list(named), list(named)
        for j, f in enumerate(fields):
            if _numeric(f):
                value = ((k * (j + 3)) % 97) / 7.0
                old.append(value.alias(f.name))
                new.append((value * (1 + ((k + j) % 5) * 0.06) + ((k + j) % 7) * 0.11).alias(f.name))
            else:
                old.append(F.concat(F.lit("t"), (k % (j + 2)).cast("string")).alias(f.name))
                new.append(F.concat(F.lit("t"), ((k + F.when((k + j) % 11 == 0, 1).otherwise(0)) % (j + 2)).cast("string")).alias(f.name))
        return D.compare_category(category, c.filter(k % 10 != 0).select(*old), c.filter(k % 10 != 1).select(*new))

    run.__name__ = f"compare_{category}"
    run.__doc__ = f"Mismatches of the category {category}."
    return run


for _category in D.CATEGORIES:
    query(_sql(_category))(_compare(_category))
