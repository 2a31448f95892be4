"""Secret scan: base patterns, and character Markov models of random strings and of ordinary identifiers.

Everything on the scoring path is a DataFrame expression. The base patterns are ``assign``, ``access`` and ``hex``. The method adds
spans of kind ``markov``: runs of 16 or more characters of ``[A-Za-z0-9+/_=-]`` whose log-likelihood under a first-order
model of random strings exceeds that under a model of ordinary identifiers by ``margin`` nats a character pair or more, and which overlap no base span.

Both models are bigram tables over a fixed alphabet of 67 symbols (so their size is bound), trained by one aggregation over labelled samples:
random strings made from digests in the usual encodings and of letters alone (label 1), and identifiers (label 0): words of a bounded sample of documents
(``sample`` rows, by a hash of doc_id) outside base spans, also joined as identifiers are (long runs that mix letters and digits have no sure label and are left out),
numbers, digits in groups, dates, rulers and a short list of words. Every run of 16 or more is scored, whatever its characters: no class of strings is ruled out before the models.

Positions come from ``split`` and ``regexp_extract_all`` with the same pattern: a match starts where the gaps and matches before it end.

Cases: a null text is empty and has no spans; repeated rows are each reported; a null doc_id stays null; other columns are not looked at;
without documents the identifier model knows the listed words, numbers and rulers alone; a long run of one letter may score as random where the sample has none; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # as long runs of [0-9a-f]+: a shorter run holds no match
RUN = r"[A-Za-z0-9+/_=-]{16,}"
KINDS = ("assign", "access", "hex", "markov")
#: Words of every corpus, so that the identifier model of a small one isn't empty.
ORDINARY = (
    "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will "
    "no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also "
    "international characteristic responsibility understanding configuration authentication implementation organisation communication environment government development experience "
    "information application connection maximum minimum default number string value object element exception abstract factory http server response request "
    "service manager transaction database session password user account message handler builder context property reference operation performance quality jumping lazy quick brown foxes "
    "between through against without because children question important different business example possible probably following including something together although however"
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

_SPANS = "array<struct<start:int,end:int,kind:int>>"


def spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """The matches of ``pattern`` that ``keep`` accepts, leftmost first, as (start, end, kind) in code points."""
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(x["m"].isNotNull() & keep(x["m"]), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))
    found = F.aggregate(parts, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column) -> list[Column]:
    return [
        spans(text, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
        spans(text, ACCESS, 1, lambda m: F.length(m) >= 20),
        spans(text, HEX, 2, lambda m: F.lit(True)),
    ]


def training_samples(docs: DataFrame, sample: int = 2_000, strings: int = 4_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sample, label): 1 a random string, 0 an ordinary identifier. Both sides are bound by the parameters."""
    spark = docs.sparkSession
    digest = F.sha2(F.col("id").cast("string"), 256)
    half = F.md5(F.concat(F.lit("x"), F.col("id").cast("string")))
    base64 = F.base64(F.unhex(F.substring(digest, 1, 48)))
    letters = F.regexp_replace(F.base64(F.unhex(F.concat(digest, half))), "[^A-Za-z]", "")
    made = F.array(base64, F.translate(base64, "+/=", "-_"), F.upper(F.regexp_replace(base64, "[+/=]", "")), F.substring(digest, 1, 40), half, F.upper(half), letters, F.lower(letters), F.upper(letters))
    random = spark.range(strings).select(F.explode(made).alias("sample"), F.lit(1).alias("label"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the least hashes of rows: only a hash travels, and only of the few rows that can be among them; equal rows are one
    keyed = docs.select(F.xxhash64(id_col, text).alias("h"), text.alias("text"))
    total = max(1, docs.count())
    most = -(1 << 63) + min((1 << 64) - 1, (1 << 64) * 4 * sample // total)
    chosen = keyed.where(F.col("h") <= F.lit(most)).select("h").distinct().orderBy("h").limit(sample)
    some = keyed.join(F.broadcast(chosen), "h").dropDuplicates(["h"])
    plain = F.regexp_replace(F.regexp_replace(F.col("text"), ASSIGN, " "), r"[0-9a-f]{24,}|AKIA[A-Z0-9]{16,}", " ")
    words = F.filter(F.split(plain, r"[^A-Za-z0-9+/_=-]+"), lambda w: (F.length(w) >= 2) & ~((F.length(w) >= 16) & w.rlike("[0-9]") & w.rlike("[A-Za-z]")))
    kinds = F.array_distinct(words)
    joined = F.array(*[F.array_join(kinds, sign) for sign in "_-/"], F.array_join(F.transform(kinds, lambda w: F.initcap(w)), ""), F.upper(F.array_join(kinds, "_")))
    ordinary = some.select(F.explode(F.concat(words, joined)).alias("sample"), F.lit(0).alias("label"))
    number = F.lpad((F.abs(F.xxhash64("id")) % 10_000_000_000_000_000).cast("string"), 16, "0")
    groups = [F.regexp_replace(number, "^(....)(....)(....)(....)$", f"$1{sign}$2{sign}$3{sign}$4") for sign in "-/_"]
    day = F.date_add(F.lit("1990-01-01").cast("date"), (F.col("id") % 20_000).cast("int")).cast("string")
    numbers = spark.range(strings).select(F.explode(F.array((F.abs(F.xxhash64("id")) % 10_000_000_000_000_000).cast("string"), *groups, F.concat_ws("/", day, day), F.concat_ws("_", day, day))).alias("sample"), F.lit(0).alias("label"))
    rulers = F.array(*[F.lit(x * 32) for x in "+/_=-"], *[F.lit(f"{a}{b * 7}" * 4) for a in "+=_-/" for b in "+=_-/" if a != b])
    rulers = spark.range(strings // 20).select(F.explode(rulers).alias("sample"), F.lit(0).alias("label"))
    known = F.split(F.lit(ORDINARY), " ")
    known = F.array(F.array_join(known, "_"), F.array_join(known, "-"), F.upper(F.array_join(known, "_")), F.array_join(F.transform(known, lambda w: F.initcap(w)), ""))
    known = spark.range(strings // 100).select(F.explode(known).alias("sample"), F.lit(0).alias("label"))
    return random.union(ordinary).union(numbers).union(rulers).union(known)


def pairs_of(token: Column) -> Column:
    """All pairs of neighbours, by one pass of the pattern."""
    return F.regexp_extract_all(token, F.lit("(?=([A-Za-z0-9+/_=-]{2}))"), F.lit(1))


def train(samples: DataFrame) -> list[float]:
    """The log-likelihood ratio of each pair of the alphabet, row by row, with add-one smoothing."""
    pair = F.explode(pairs_of(F.col("sample")))
    counts = samples.where(F.length("sample") >= 2).select("label", pair.alias("pair")).groupBy("label", "pair").count()
    k = len(ALPHABET)
    table = {0: [[1.0] * k for _ in range(k)], 1: [[1.0] * k for _ in range(k)]}
    for r in counts.collect():  # at most 2 * 67 * 67 rows
        a, b = (ALPHABET.index(c) for c in r["pair"])
        table[r["label"]][a][b] += r["count"]
    out = []
    for a in range(k):
        s1, s0 = sum(table[1][a]), sum(table[0][a])
        out += [math.log(table[1][a][b] / s1) - math.log(table[0][a][b] / s0) for b in range(k)]
    return out


def ratio(token: Column, table: Column) -> Column:
    """The mean log-likelihood ratio of the token's character pairs."""
    place = lambda pair, i: F.instr(F.lit(ALPHABET), F.substring(pair, i, 1)) - 1
    total = F.aggregate(pairs_of(token), F.lit(0.0), lambda acc, p: acc + F.element_at(table, place(p, 1) * len(ALPHABET) + place(p, 2) + 1))
    return total / (F.length(token) - 1)


def find_secrets(docs: DataFrame, model: list[float] | None = None, margin: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): all spans as an array of (start, end, kind), by start and then by kind."""
    table = F.lit(model if model is not None else train(training_samples(docs, id_col=id_col, text_col=text_col)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.concat(*base_spans(F.col("text"))).alias("base"))
    more = spans(F.col("text"), RUN, 3, lambda m: ratio(m, table) >= margin)
    free = F.filter(more, lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    order = lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["kind"] < b["kind"], -1).when(a["kind"] > b["kind"], 1).otherwise(0)
    return rows.select("doc_id", F.array_sort(F.concat("base", free), order).alias("spans"))


def span_string(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
