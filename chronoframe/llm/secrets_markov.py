"""Secret scans with patterns and character Markov models, in DataFrame functions only.

Two first-order Markov models, one of random strings and one of ordinary identifiers,
are trained from labelled samples. Of a long run of token characters the stretches are
reported where the logarithm of the likelihood ratio is high enough, whatever stands
beside them. The patterns' matches are always kept, and cut out of the runs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm.common import numbered, renamed

#: The base patterns, in the order of their kinds. Fixed values.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = (("assign", ASSIGN), ("access", r"AKIA[A-Z0-9]{12,}"), ("hex", r"[0-9a-f]{32,}"))
LEAST_VALUE = 8
#: Runs that the models judge, and the ratio that reports one: in all, and for each character.
RUN = r"[A-Za-z0-9+/_=-]{16,}"
KIND = "random"
LEAST_RATIO, LEAST_A_CHARACTER = 12.0, 0.6
#: The shortest stretch of a run that is judged by itself, and what a stretch is made whole to.
LEAST_STRETCH, PIECE = 16, "[A-Za-z0-9+]"
#: Bounds of the labelled samples: random strings, and characters of the different texts whose words are the
#: identifiers (expected; a hash of the text chooses, and one at least is read whole).
RANDOM_STRINGS, SAMPLE_CHARS = 3000, 2_000_000
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET) + 2  # 0: any other character; the last: the start of a string
OPEN, CLOSE, OTHER = "\u0001", "\u0002", "\u0003"
BLOCK = 256


# ---- places of matches


def _marked(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}"))


def _spans(marked: Column) -> Column:
    """array<struct<s, e, m>>: start, end and text of each marked match, in code points.

    Positions add up the lengths before; this is done within blocks of pieces and then
    over blocks, so that the work does not grow with the square of the matches.
    """
    pieces = F.split(marked, OPEN)

    def within(block):
        zero = F.struct(F.lit(0).alias("n"), F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)").alias("out"))

        def add(acc, piece):
            hit = F.substring_index(piece, CLOSE, 1)
            isa = F.instr(piece, CLOSE) > 0
            size = F.length(hit)
            one = F.struct(acc["n"].alias("s"), (acc["n"] + size).alias("e"), hit.alias("m"))
            return F.struct((acc["n"] + F.length(piece) - F.when(isa, 1).otherwise(0)).alias("n"), F.when(isa, F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(block, zero, add)

    starts = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int"))
    blocks = F.transform(starts, lambda i: within(F.slice(pieces, i * BLOCK + 1, F.lit(BLOCK))))
    zero = F.struct(F.lit(0).alias("n"), F.expr("cast(array() as array<array<struct<s:int,e:int,m:string>>>)").alias("out"))

    def shift(acc, block):
        moved = F.transform(block["out"], lambda x: F.struct((x["s"] + acc["n"]).alias("s"), (x["e"] + acc["n"]).alias("e"), x["m"].alias("m")))
        return F.struct((acc["n"] + block["n"]).alias("n"), F.array_append(acc["out"], moved).alias("out"))

    return F.when(F.instr(marked, OPEN) > 0, F.flatten(F.aggregate(blocks, zero, shift)["out"])).otherwise(F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)"))


def _clean(text: Column) -> Column:
    """The text with the two marks replaced by a third control character: no pattern matches any of them."""
    has = (F.instr(text, OPEN) > 0) | (F.instr(text, CLOSE) > 0)
    return F.when(has, F.translate(text, OPEN + CLOSE, OTHER + OTHER)).otherwise(text)


# ---- the models


def _codes(s: Column, i: Column) -> Column:
    """Code of the i-th character of a string; that before the first is the start."""
    return F.when(i == 0, F.lit(SIZE - 1)).otherwise(F.instr(F.lit(ALPHABET), F.substring(s, i, 1)))


def _steps(strings: DataFrame) -> DataFrame:
    """Counts of the steps between characters of strings(label, s)."""
    at = strings.where(F.length("s") > 0).select("label", "s", F.explode(F.sequence(F.lit(1), F.length("s"))).alias("i"))
    return at.groupBy("label", _codes(F.col("s"), F.col("i") - 1).alias("a"), _codes(F.col("s"), F.col("i")).alias("b")).agg(F.count(F.lit(1)).alias("c"))


def labelled(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """(label, s): random strings made from digests, and identifiers made of the words of a bounded sample of texts, with some decimal numbers."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    base = F.base64(F.unhex(digest))
    random = spark.range(RANDOM_STRINGS).select(F.explode(F.array(digest, base, F.upper(F.regexp_replace(base, F.lit("[^A-Za-z0-9]"), F.lit(""))))).alias("s"))
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    chars, least = texts.agg(F.sum(F.length("text").cast("bigint")), F.min(place)).first()
    last = max(least or 0, int((1 << 30) * min(1.0, SAMPLE_CHARS / max(1, chars or 0))))
    near = texts.where(place <= last).distinct()
    words = F.filter(F.split("text", r"[^A-Za-z0-9]+"), lambda w: (F.length(w) > 1) & (F.length(w) < 16))
    glue = F.array(*[F.lit(x) for x in ("_", "-", "/", "", "=")])
    own = near.select(words.alias("w")).where(F.size("w") > 1).select("w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("i"))
    first, second = F.element_at("w", F.col("i")), F.element_at("w", F.col("i") + 1)
    turn = F.pmod(F.hash(first, second), F.lit(35))
    ident = F.concat(first, F.element_at(glue, (turn % 5 + 1).cast("int")), F.when(turn % 3 == 0, F.initcap(second)).otherwise(second), F.when(turn % 7 == 0, turn.cast("string")).otherwise(""))
    number = F.conv(F.substring(F.sha2(F.concat(F.lit("n"), F.col("id").cast("string")), 256), 1, 14), 16, 10)
    ordinary = own.select(ident.alias("s")).unionByName(spark.range(RANDOM_STRINGS).select(number.alias("s")))
    return random.select(F.lit(1).alias("label"), "s").unionByName(ordinary.select(F.lit(0).alias("label"), "s"))


def train(spark: SparkSession, texts: DataFrame) -> list[float]:
    """log P(b after a | random) - log P(b after a | identifier) at a * SIZE + b, smoothed by adding 0.5."""
    counts = [[0.5] * (SIZE * SIZE) for _ in range(2)]
    for r in _steps(labelled(spark, texts)).collect():
        counts[r["label"]][r["a"] * SIZE + r["b"]] += r["c"]
    totals = [[sum(c[a * SIZE : (a + 1) * SIZE]) for a in range(SIZE)] for c in counts]
    return [math.log(counts[1][i] / totals[1][i // SIZE]) - math.log(counts[0][i] / totals[0][i // SIZE]) for i in range(SIZE * SIZE)]


def ratios(s: Column, model: list[float]) -> Column:
    """Logarithm of the likelihood ratio of each character of a string."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")  # folded once, when the plan is made
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.element_at(table, (_codes(s, i - 1) * SIZE + _codes(s, i) + 1).cast("int")))


def ratio(s: Column, model: list[float]) -> Column:
    """Logarithm of the likelihood ratio of a string."""
    return F.aggregate(ratios(s, model), F.lit(0.0), lambda acc, x: acc + x)


def _stretches(steps: Column) -> Column:
    """array<struct<s, e>>: stretches of characters' ratios that reach the least ratio, in all and for each character.

    A stretch begins where the sum of what is above the least for a character rises from zero and
    ends at its highest, once the sum has fallen to zero or by the least ratio.
    """
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("s"), F.lit(0.0).alias("up"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("top"), F.lit(0.0).alias("top_sum"), F.lit(0).alias("e"), F.expr("cast(array() as array<struct<s:int,e:int>>)").alias("out"))

    def closed(acc):
        good = (acc["top_sum"] >= LEAST_RATIO) & (acc["e"] - acc["s"] >= LEAST_STRETCH)
        return F.when(good, F.array_append(acc["out"], F.struct(acc["s"].alias("s"), acc["e"].alias("e")))).otherwise(acc["out"])

    def add(acc, x):
        up = acc["up"] + x - LEAST_A_CHARACTER
        higher = up > acc["top"]
        over = (up <= 0) | (acc["top"] - up >= LEAST_RATIO)
        end = F.struct((acc["i"] + 1).alias("i"), (acc["i"] + 1).alias("s"), F.lit(0.0).alias("up"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("top"), F.lit(0.0).alias("top_sum"), F.lit(0).alias("e"), closed(acc).alias("out"))
        total = acc["sum"] + x
        more = F.struct((acc["i"] + 1).alias("i"), acc["s"].alias("s"), up.alias("up"), total.alias("sum"), F.when(higher, up).otherwise(acc["top"]).alias("top"), F.when(higher, total).otherwise(acc["top_sum"]).alias("top_sum"), F.when(higher, acc["i"] + 1).otherwise(acc["e"]).alias("e"), acc["out"].alias("out"))
        return F.when(over, end).otherwise(more)

    return F.aggregate(steps, zero, add, closed)


def _reported(run: Column, model: list[float]) -> Column:
    """array<struct<s, e>> of a run(s, e, m) of the text: all of it if it reaches the limit, else its stretches, made whole to the separators beside them."""
    m, size = run["m"], F.length(run["m"])
    whole = F.array(F.struct(run["s"].alias("s"), run["e"].alias("e")))

    def judged(steps):
        limit = F.greatest(F.lit(LEAST_RATIO), F.lit(LEAST_A_CHARACTER) * size)

        def grown(x):
            left = F.length(F.regexp_extract(F.substring(m, F.lit(1), x["s"]), f"{PIECE}*$", 0))
            right = F.length(F.regexp_extract(F.substring(m, x["e"] + 1, size), f"^{PIECE}*", 0))
            return F.struct((run["s"] + x["s"] - left).alias("s"), (run["s"] + x["e"] + right).alias("e"))

        return F.when(F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x) >= limit, whole).otherwise(F.array_distinct(F.transform(_stretches(steps), grown)))

    return F.flatten(F.transform(F.array(ratios(m, model)), judged))


def _outside(run: Column) -> Column:
    """array<struct<s, e, m>>: what the base spans, sorted by start, leave of a run."""
    near = F.filter("base", lambda b: (b["s"] < run["e"]) & (run["s"] < b["e"]))
    zero = F.struct(run["s"].alias("at"), F.expr("cast(array() as array<struct<s:int,e:int>>)").alias("out"))

    def cut(acc, b):
        left = F.array_append(acc["out"], F.struct(acc["at"].alias("s"), b["s"].alias("e")))
        return F.struct(F.greatest(acc["at"], b["e"]).alias("at"), F.when(b["s"] > acc["at"], left).otherwise(acc["out"]).alias("out"))

    rest = F.aggregate(near, zero, cut, lambda acc: F.array_append(acc["out"], F.struct(acc["at"].alias("s"), run["e"].alias("e"))))
    named = F.transform(F.filter(rest, lambda x: x["e"] - x["s"] >= LEAST_STRETCH), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.substring(run["m"], x["s"] - run["s"] + 1, x["e"] - x["s"]).alias("m")))
    return F.when(F.size(near) > 0, named).otherwise(F.array(run))


# ---- the scan


def scan(docs: DataFrame, model: list[float] | None = None, text: str = "text") -> DataFrame:
    """Adds base and spans to docs(text, ...): array<struct<s, k, e, kind>> by start, then kind.

    A null text counts as empty and has no spans. Other columns stay, but for older ones
    of the names base and spans. Without a model one is trained on the same texts. An
    empty table gives none; a text of any length is scanned whole.
    """
    own, at = numbered(docs.drop("base", "spans"))
    value = F.coalesce(at[text], F.lit(""))
    model = model or train(docs.sparkSession, own.select(value.alias("text")))
    return _scanned(own, at[text], model).select(*renamed(at), "base", "spans")


def _scanned(own: DataFrame, text: str, model: list[float]) -> DataFrame:
    """Adds base and spans to numbered columns."""
    kept = own.columns
    out = own.withColumn("clean", _clean(F.coalesce(text, F.lit(""))))
    for kind, pattern in PATTERNS:
        out = out.withColumn(kind, _marked(F.col("clean"), pattern))
    out = out.withColumn("runs", _marked(F.col("clean"), RUN))

    def kinded(spans, k, kind):
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind")))

    found = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        spans = _spans(F.col(kind))
        if kind == "assign":
            spans = F.filter(spans, lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 1)) >= LEAST_VALUE)
        found.append(kinded(spans, k, kind))
    out = out.withColumn("base", F.array_sort(F.concat(*found)))
    out = out.withColumn("rest", F.flatten(F.transform(_spans(F.col("runs")), _outside)))
    more = F.flatten(F.transform("rest", lambda x: _reported(x, model)))
    return out.withColumn("spans", F.array_sort(F.concat("base", kinded(more, len(PATTERNS), KIND)))).select(*kept, "base", "spans")


def _said(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of docs(doc_id, text).

    Null texts have no spans; null ids stay null; repeated rows give equal rows; an empty
    table gives none. A text of any length is scanned whole, in time that grows with it.
    """
    found = scan(docs.select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint")
    counts = [of(kind).alias(f"n_{kind}") for kind, _ in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(_said("base").cast("binary"), 256).alias("base_sha256"), _said("spans").alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each run of overlapping spans in text replaced by a mark, and n_chars set where there is one.

    A null text stays null, other columns stay as they are whatever their names, repeated
    rows stay, and an empty table gives none.
    """
    own, at = numbered(docs)
    model = train(docs.sparkSession, own.select(F.coalesce(at["text"], F.lit("")).alias("text")))
    found = _scanned(own, at["text"], model)
    text = F.col(at["text"])
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc, x):
        new = x["s"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(new, F.array_append(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    out = found.withColumn("done", F.when(F.size("spans") > 0, F.aggregate("spans", zero, step)))
    rest = F.substring(text, F.col("done.at") + 1, F.length(text))
    out = out.withColumn("left", F.when(F.col("done").isNull(), text).otherwise(F.concat(F.array_join("done.out", ""), rest)))
    new = {"text": F.col("left")}
    if "n_chars" in at:
        new["n_chars"] = F.length("left").cast(docs.schema["n_chars"].dataType)
    return out.select(renamed(at, **new))
