"""Secret scans through a trigram inverted index: Boolean trigram queries, intersected postings, verified candidates."""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, documents, text_or_empty


@dataclass(frozen=True)
class Rule:
    """A kind of secret: pattern (Java and Python syntax alike) and, if set, the least length of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base kinds, in the order in which spans at one start are listed.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
# Further kinds, published token formats.
EXTRA = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)

# How many strings a part of a pattern may stand for before only "anything" is said of it.
MOST = 16
# Candidates are broadcast up to so many rows, of about 50 bytes each.
BROADCAST_ROWS = 500_000
NO_SPANS = "CAST(array() AS array<struct<start:int,order:int,kind:string,end:int>>)"


def trigrams(word: str) -> frozenset[str]:
    return frozenset(word[i : i + 3] for i in range(len(word) - 2))


def literals(parsed) -> list[str] | None:
    """All lower-case strings that a parsed pattern can match, or None if they are many."""
    found = [""]
    for op, arg in parsed:
        if op is sre.LITERAL:
            part = [chr(arg).lower()]
        elif op is sre.SUBPATTERN:
            part = literals(arg[3])
        elif op is sre.BRANCH:
            branches = [literals(x) for x in arg[1]]
            part = None if None in branches else [s for x in branches for s in x]
        elif op is sre.MAX_REPEAT and arg[1] is not sre.MAXREPEAT and arg[1] <= 3:
            once = literals(arg[2])
            part = None if once is None else [s * k for k in range(arg[0], arg[1] + 1) for s in once]
        elif op is sre.IN and all(x[0] is sre.LITERAL for x in arg):
            part = sorted({chr(x[1]).lower() for x in arg})
        else:
            part = None
        if part is None or len(part) * len(found) > MOST:
            return None
        found = [a + b for a in found for b in part]
    return found


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The Boolean query of a pattern: a match has all trigrams of one of the returned sets. [] means no trigram is mandatory.

    Trigrams are of the lower-cased text, so a query can only admit more documents than the pattern matches.
    """
    best: list[frozenset[str]] = []
    parts = list(sre_parser.parse(pattern))
    for i in range(len(parts)):
        longest = None
        for j in range(i + 1, len(parts) + 1):
            strings = literals(parts[i:j])
            if strings is None:
                break
            longest = strings
        if longest and all(trigrams(s) for s in longest):
            query = [trigrams(s) for s in longest]
            if not best or min(map(len, query)) > min(map(len, best)):
                best = query
    return best


def postings(docs: DataFrame, wanted: list[str], key: str = "_key", text: str = "_text") -> DataFrame:
    """The inverted index for the trigrams in `wanted`: a row (trigram, key) for each that a text holds, in lower case."""
    low = docs.select(key, F.lower(text).alias("_low"))
    held = F.filter(F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in wanted]), lambda t: t.isNotNull())
    return low.select(F.explode(held).alias("trigram"), key)


def candidates(index: DataFrame, rules: list[tuple[int, list[frozenset[str]]]], key: str = "_key") -> DataFrame:
    """Intersect postings: keys with the sorted numbers of the rules whose query they meet. The rule table is a few dozen rows."""
    clauses = [(t, n, c, len(clause)) for n, query in rules for c, clause in enumerate(query) for t in sorted(clause)]
    spark = index.sparkSession
    table = spark.createDataFrame(clauses, "trigram string, rule int, clause int, size int")
    return (
        index.join(F.broadcast(table), "trigram")
        .groupBy(key, "rule", "clause", "size")
        .agg(F.count(F.lit(1)).alias("held"))
        .where("held = size")
        .groupBy(key)
        .agg(F.sort_array(F.collect_set("rule")).alias("_rules"))
    )


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Leftmost non-overlapping matches as an array of (start, order, kind, end), in code points, short ones left out.

    The pieces between matches and the matches give the places by a running sum.
    """
    pattern = F.lit(rule.pattern)
    lengths = lambda values: F.transform(values, lambda x: F.char_length(x))
    gaps = lengths(F.split(text, rule.pattern))
    matches = lengths(F.regexp_extract_all(text, pattern, F.lit(0)))
    judged = matches if rule.group == 0 else lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group)))
    placed = F.aggregate(
        F.arrays_zip(F.slice(gaps, F.lit(1), F.size(matches)).alias("g"), matches.alias("m"), judged.alias("j")),
        F.struct(F.lit(0).alias("at"), F.expr(NO_SPANS).alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["g"] + x["m"]).alias("at"),
            F.when(
                x["j"] >= rule.least,
                F.array_append(
                    acc["out"],
                    F.struct(
                        (acc["at"] + x["g"]).alias("start"),
                        F.lit(order).alias("order"),
                        F.lit(rule.kind).alias("kind"),
                        (acc["at"] + x["g"] + x["m"]).alias("end"),
                    ),
                ),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(F.regexp(text, pattern), placed)


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_secrets(
    docs: DataFrame, rules: tuple[Rule, ...] = BASE + EXTRA, keys: tuple[str, ...] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """All spans of all rules in each text: adds column `found`, an array of (start, order, kind, end) by start and rule order.

    Rules with mandatory trigrams are looked up in the trigram index and verified on the candidates only; the others scan
    every text. The candidates (a key and a few small numbers) are broadcast when they are BROADCAST_ROWS at most, and
    joined by a shuffle beyond. Starts and ends count code points, the end is exclusive; spans of different kinds may overlap.

    Null texts count as empty and have no spans; repeated rows are scanned each; an empty table gives no rows. The columns
    of `docs` are kept, those named _key, _text, _rules or found excepted, which are replaced.
    """
    docs = docs.drop("_key", "_text", "_rules", "found")
    queries = [(n, trigram_query(rule.pattern)) for n, rule in enumerate(rules)]
    indexed = [(n, q) for n, q in queries if q]
    whole = [n for n, q in queries if not q]
    # a key need not be unique: a row that shares one is verified in vain at worst
    keyed = docs.withColumn("_text", text_or_empty(text)).withColumn("_key", F.xxhash64(*[F.col(k) for k in keys]))
    out = keyed.withColumn("_rules", F.lit(None).cast("array<int>"))
    if indexed:
        wanted = sorted({t for _, q in indexed for clause in q for t in clause})
        found = checkpoint(candidates(postings(keyed, wanted).distinct(), indexed))
        small = found.count() <= BROADCAST_ROWS
        out = keyed.join(F.broadcast(found) if small else found, "_key", "left")
    parts = [spans(F.col("_text"), rules[n], n) for n in whole]
    parts += [F.when(F.array_contains("_rules", n), spans(F.col("_text"), rules[n], n)) for n, _ in indexed]
    every = F.array_sort(F.flatten(F.array(*[F.coalesce(p, F.expr(NO_SPANS)) for p in parts])))
    return out.withColumn("found", every).drop("_key", "_text", "_rules")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every whole text of `documents`; the base kinds are counted and digested apart."""
    found = scan_secrets(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "found")
    base = F.filter("found", lambda s: s["order"] < len(BASE))
    at = lambda n: lambda s: s["order"] == n
    number = [
        F.size(F.filter("found", at(n))).cast("long").alias(f"n_{rule.kind}") for n, rule in enumerate(BASE)
    ]
    return found.select(
        "doc_id", *number, F.sha2(F.encode(listed(base), "utf-8"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans")
    )


def _found(order: int, rule: Rule) -> str:
    pattern = "'" + rule.pattern.replace("'", "''") + "'"
    return (
        f"SELECT doc_id, {order} AS ord, '{rule.kind}' AS kind, {rule.least} AS least, string_split_regex(t, {pattern}) AS gaps, "
        f"regexp_extract_all(t, {pattern}, 0) AS found, regexp_extract_all(t, {pattern}, {rule.group}) AS judged FROM d WHERE regexp_matches(t, {pattern})"
    )


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_found(n, rule) for n, rule in enumerate(BASE + EXTRA))}),
p AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m),
q AS (SELECT *, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS first FROM p WHERE length(judged[i]) >= least),
s AS (SELECT doc_id, ord, first, kind || ':' || first || ':' || (first + length(found[i])) AS said FROM q)
SELECT d.doc_id, {", ".join(f"count(s.ord) FILTER (WHERE s.ord = {n}) AS n_{rule.kind}" for n, rule in enumerate(BASE))},
  sha256(coalesce(string_agg(s.said, ',' ORDER BY s.first, s.ord) FILTER (WHERE s.ord < {len(BASE)}), '')) AS base_sha256,
  coalesce(string_agg(s.said, ',' ORDER BY s.first, s.ord), '') AS spans
FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""
