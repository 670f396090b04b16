"""Secret scans: fixed patterns plus a character Markov model, with DataFrame and SQL functions only.

Two bigram models over a small alphabet, one of random strings and one of ordinary identifiers, are trained from
labelled samples. A run of key characters whose mean log-likelihood ratio (bits a transition, random against
ordinary) is above a threshold in the whole or in any stretch of LEAST_STRETCH characters or more is reported as
kind `markov`, unless it touches a span of a fixed pattern. So ordinary words around a key do not hide it; the span
is the whole run, as the span of an assignment has its name in it.

Spark has no function for the places of all matches, so they follow from the lengths of what lies between them
(`split` with the same pattern). Places count code points; ends are exclusive.

Defined cases: a null text has no spans, like an empty one; null doc_ids and repeated rows are rows like others;
an empty table gives no rows; with no labelled samples of one kind the model finds nothing.
"""

from __future__ import annotations

import json
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds in order, their patterns, the group that is measured and its least length.
KINDS = ("assign", "access", "hex", "markov")
PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
# Words that identifiers are usually made of.
COMMON_WORDS = """user name value index count config file path list item data type error request response session client server
handler manager service factory builder helper message event queue table column query result cache buffer string number object
array field key group order customer account address email phone country language version update create delete insert select
filter parse format print write read open close start stop begin end first last next previous total average window frame
default public private static final class method function module package import export test example project system process
thread worker task job stage batch stream record document text token label source target weight size length width height""".split()
#: Bits a transition above which a candidate is taken for random.
THRESHOLD = 1.0
#: Characters of the shortest stretch of a candidate that is judged alone.
LEAST_STRETCH = 20
#: Counts of the overall frequencies that are mixed into those after each character.
PRIOR = 5
#: Labelled rows of each class that the model is fitted on: a bounded sample.
SAMPLE_ROWS = 20000


def _pairs_sql(text: str) -> str:
    """SQL for the characters of `text` as places in ALPHABET, 0 for any other."""
    return f"transform(filter(split({text}, ''), c -> c <> ''), c -> instr('{ALPHABET}', c))"


def labelled_samples(spark: SparkSession, docs: DataFrame, rows: int = SAMPLE_ROWS, text: str = "text") -> DataFrame:
    """(sample, random boolean): random strings written in the usual key alphabets; ordinary ones of words of `docs` and of pairs of COMMON_WORDS.

    Ordinary words come from the `rows // 100` documents of smallest text hash, so the sample is the same on every
    run; words that hold digits are left out, as they may be keys. Each also appears upper-cased and joined in pairs.
    """
    digest = F.sha2(F.col("id").cast("string"), 512)
    base64 = F.regexp_replace(F.base64(F.unhex(F.substring(digest, 1, 66))), "\\s", "")
    styles = F.array(F.substring(digest, 67, 40), F.substring(base64, 1, 40), F.substring(F.upper(base64), 1, 20))
    noise = spark.range(rows // 3).select(F.explode(styles).alias("sample"), F.lit(True).alias("random"))
    chosen = docs.select(F.col(text).alias("t")).where("t IS NOT NULL AND t <> ''").orderBy(F.xxhash64("t")).limit(max(1, rows // 100))
    words = chosen.select(F.explode(F.regexp_extract_all("t", F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{4,}(?![A-Za-z0-9+/_=-])"), F.lit(0))).alias("w"))
    words = words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(rows)
    common = spark.createDataFrame([(" ".join(COMMON_WORDS),)], "all string").select(F.split("all", " ").alias("all"))
    common = common.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b"))
    joined = common.select(F.explode(F.array(F.concat_ws("_", "a", "b"), F.concat("a", F.initcap("b")), F.concat("a", "b"), F.upper(F.concat_ws("_", "a", "b")), F.concat_ws("-", "a", "b"), F.concat_ws("/", "a", "b"), F.concat_ws("=", "a", "b"))), F.lit(False))
    written = words.select(F.explode(F.array(F.col("w"), F.upper("w"), F.concat_ws("_", "w", F.lower("w")), F.concat("w", F.initcap("w")))), F.lit(False))
    return noise.union(written).union(joined)


def train(samples: DataFrame, sample: str = "sample", random: str = "random") -> list[float] | None:
    """Log-likelihood ratios log2 P(b | a, random) - log2 P(b | a, ordinary), row by row.

    A character's frequencies after another are smoothed by PRIOR counts in proportion to its overall (add-one) frequency.

    The result is of fixed size, the alphabet's square; None if a class has no samples.
    """
    k = len(ALPHABET) + 1
    pairs = samples.where(F.col(sample).isNotNull() & F.col(random).isNotNull()).select(F.expr(_pairs_sql(f"`{sample}`")).alias("s"), F.col(random).alias("r"))
    pairs = pairs.where("size(s) > 1").select("r", F.expr(f"explode(transform(sequence(0, size(s) - 2), i -> s[i] * {k} + s[i + 1]))").alias("p"))
    counts: dict[tuple[bool, int], int] = {(row["r"], row["p"]): row["count"] for row in pairs.groupBy("r", "p").count().collect()}
    if len({r for r, _ in counts}) < 2:
        return None
    def logs(r: bool) -> list[float]:
        after = [[counts.get((r, a * k + b), 0) for b in range(k)] for a in range(k)]
        alone = [sum(row[b] for row in after) + 1 for b in range(k)]
        share = [n / sum(alone) for n in alone]
        return [log2((n + PRIOR * p) / (sum(row) + PRIOR)) for row in after for n, p in zip(row, share, strict=True)]

    return [round(x - y, 3) for x, y in zip(logs(True), logs(False), strict=True)]


def _matches(text: str, pattern: str, group: int, least: int, kind: str) -> str:
    """SQL for array<struct<start, kind, end>> of the matches of a pattern whose group is long enough."""
    q = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    found = f"regexp_extract_all({text}, {q}, 0)"
    value = f"regexp_extract_all({text}, {q}, {group})"
    rank = KINDS.index(kind)
    step = "named_struct('at', a.at + length(x.gap) + length(x.hit), 'out', CASE WHEN length(x.val) >= {least} THEN array_append(a.out, named_struct('start', a.at + length(x.gap), 'kind', {rank}, 'end', a.at + length(x.gap) + length(x.hit))) ELSE a.out END)".format(least=least, rank=rank)
    zipped = f"zip_with(zip_with(split({text}, {q}, -1), {found}, (g, h) -> named_struct('gap', g, 'hit', h)), {value}, (p, v) -> named_struct('gap', p.gap, 'hit', p.hit, 'val', v))"
    fold = f"aggregate(filter({zipped}, x -> x.hit IS NOT NULL), named_struct('at', 0, 'out', cast(array() AS array<struct<start: int, kind: int, end: int>>)), (a, x) -> {step}, a -> a.out)"
    return f"CASE WHEN {text} RLIKE {q} THEN {fold} ELSE cast(array() AS array<struct<start: int, kind: int, end: int>>) END"


def scan_secrets(docs: DataFrame, model: list[float] | None, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """`docs` with `base` and `spans`: arrays of (start, kind, end), ordered; kind is a place in KINDS.

    Purely per row: no shuffle. A text that holds no match of a pattern is searched once and not split. Input columns
    named `base` or `spans` are replaced; all others stay, whatever their names.
    """
    docs = docs.drop("base", "spans")
    own = "_s"  # begins the names of columns that are only made on the way
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    t = f"{own}t"
    out = docs.withColumn(t, F.coalesce(F.col(f"`{text}`"), F.lit("")))
    for kind, (pattern, group, least) in PATTERNS.items():
        out = out.withColumn(f"{own}{kind}", F.expr(_matches(t, pattern, group, least, kind)))
    out = out.withColumn("base", F.array_sort(F.concat(f"{own}assign", f"{own}access", f"{own}hex")))
    if model is None:
        out = out.withColumn(f"{own}markov", F.expr("cast(array() AS array<struct<start: int, kind: int, end: int>>)"))
    else:
        k = len(ALPHABET) + 1
        found = out.withColumn(f"{own}c", F.expr(_matches(t, CANDIDATE, 0, 0, "markov")))
        table = f"from_json('{json.dumps(model)}', 'array<double>')"
        apart = "NOT exists(base, b -> b.start < x.end AND x.start < b.end)"
        states = _pairs_sql(f"substring({t}, x.start + 1, x.end - x.start)")
        # s and l are the sums of what exceeds the threshold up to a transition and up to LEAST_STRETCH - 1 before it, m the least l.
        excess = f"transform(c, (x, i) -> CASE WHEN i = 0 THEN 0D ELSE {table}[c[i - 1] * {k} + x] - {threshold}D END)"
        lag = LEAST_STRETCH - 1
        step = f"named_struct('s', a.s + e[i], 'l', a.l + IF(i >= {lag}, e[i - {lag}], 0D), 'm', IF(i >= {lag}, least(a.m, a.l + e[i - {lag}]), a.m), 'b', IF(i >= {lag}, greatest(a.b, a.s + e[i] - least(a.m, a.l + e[i - {lag}])), a.b))"
        best = f"transform(array({excess}), e -> aggregate(sequence(0, size(e) - 1), named_struct('s', 0D, 'l', 0D, 'm', 0D, 'b', double('-inf')), (a, i) -> {step}, a -> a.b))[0]"
        above = f"transform(array({states}), c -> {best})[0] > 0"
        out = found.withColumn(f"{own}markov", F.expr(f"filter({own}c, x -> {apart} AND {above})"))
    out = out.withColumn("spans", F.array_sort(F.concat("base", f"{own}markov")))
    return out.drop(*[c for c in out.columns if c.startswith(own)])


def span_text(spans: Column) -> Column:
    """`kind:start:end` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(scanned: DataFrame, mark: str = "[SECRET]", text: str = "text") -> DataFrame:
    """Replaces every stretch of text under a span by `mark` and drops the spans; overlapping spans are one stretch."""
    fold = f"""aggregate(spans, named_struct('at', 0, 'out', ''), (a, s) -> CASE
        WHEN s.end <= a.at THEN a
        WHEN s.start < a.at THEN named_struct('at', s.end, 'out', a.out)
        ELSE named_struct('at', s.end, 'out', concat(a.out, substring(`{text}`, a.at + 1, s.start - a.at), '{mark}')) END,
        a -> concat(a.out, substring(`{text}`, a.at + 1)))"""
    return scanned.withColumn(text, F.expr(f"CASE WHEN size(spans) > 0 THEN {fold} ELSE `{text}` END")).drop("spans", "base")
