"""Personal data in texts: fixed patterns, and contextual extraction bootstrapped from what these find. DataFrame operations only.

Base kinds are found by pattern and checked by value (octets, Luhn sums, number
of digits). The patterns given to Spark match what the plain ones below match,
leftmost and not overlapping, in time linear in the text: quantifiers never
give back, and a match only begins where a run begins or the last match ended.

The contextual part starts from seeds: these entities, and values that a label
word with ``=`` or ``:`` introduces. Candidates are words with a digit or an at
sign, without the punctuation around them. Each has lexical patterns: the two
words before it (L), the word before and the word after (B), the label that
introduces it (N) and its shape, if it has eight characters or more (S).
Patterns and candidate values form a bipartite graph of distinct pairs. A
pattern is admitted once ``support`` of its distinct values are known: seeds, or
found in an earlier round with a score of at least ``confidence``. In each round
an admitted pattern's confidence is the smoothed mean score of its values, and
the score of a value that is no seed is the mean confidence of its admitted
patterns. What patterns of seeds discover so admits further patterns, and these
discover more. Rounds go on until none is admitted and no confidence has moved
by more than ``settled``; patterns are only ever added, so they end. A value
that has the form of a card or an address but fails the check is a
counterexample, unless a label introduces it: it scores 0 and is not marked.
Patterns that end with a high confidence mark their candidates as ``ctx``,
labelled or not, known as seeds or not. Patterns and values are 64-bit hashes in
the graph, so that long words cost no more than others. The graph is aggregated
before it is shuffled, nothing is collected, and each round's scores are
written out.

Offsets count code points; ends are exclusive. Defined results: a null or empty
text has no spans; rows that repeat each have their own result; null ids and
columns of other names do not matter; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Fixed values, in order: kind, the plain pattern, and the one that runs.
KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9]([\x20-]?[0-9])+", r"[0-9](?:[\x20-]?[0-9]){12,}+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
SPAN = "struct<s:int,e:int,t:string>"


#: Matches whose offsets are summed at once; an array that grows by one element is copied each time.
RUN = 64


def _found(text: Column, pattern: str) -> Column:
    """Start, end and text of every match, from the lengths of the matches and of what lies between them.

    Offsets are summed within runs of matches and then over the runs.
    """
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + x["g"]
        e = s + F.coalesce(F.length(x["m"]), F.lit(0))
        return F.struct(e.alias("at"), F.when(x["m"].isNull(), a["out"]).otherwise(F.array_append(a["out"], F.struct(s.alias("s"), e.alias("e"), x["m"].alias("t")))).alias("out"))

    def run(part: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.aggregate(part, none, step)

    def shift(r: Column, by: Column) -> Column:
        return F.transform(r["out"], lambda x: F.struct((x["s"] + by).alias("s"), (x["e"] + by).alias("e"), x["t"].alias("t")))

    def all_runs(one: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(one), F.lit(RUN))
        runs = F.transform(starts, lambda i: run(F.slice(one, i, F.lit(RUN))))
        return F.transform(F.array(runs), lambda r: F.struct(r.alias("runs"), F.aggregate(r, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x["at"])).alias("before")))[0]

    # The one-element arrays name a value that is used twice, so that it is computed once.
    both = F.transform(F.array(parts), all_runs)[0]
    return F.transform(F.array(both), lambda b: F.flatten(F.zip_with(b["runs"], F.slice(b["before"], F.lit(1), F.size(b["runs"])), shift)))[0]


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def _luhn(t: Column) -> Column:
    d = _digits(t)
    n = F.length(d)

    def term(i: Column) -> Column:
        x = F.substring(d, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0))

    return (n <= 19) & (F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + term(i)) % 10 == 0)


def _octets(t: Column) -> Column:
    return F.forall(F.split(t, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(F.split(t, r"\."), lambda p: F.concat(F.lit("0"), F.right(p, F.lit(3))).cast("int") <= 255)


def _short(t: Column) -> Column:
    return F.length(_digits(t)).between(9, 15)


CHECKS = {"email": None, "ip": _octets, "card": _luhn, "phone": _short}


def _checked(check):
    return lambda x: check(x["t"])


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind an array of spans in order of start. text must not be null."""
    has_digit = text.rlike("[0-9]")
    may = {"email": F.contains(text, F.lit("@")), "ip": has_digit, "card": has_digit, "phone": F.contains(text, F.lit("+"))}
    none = F.array().cast(f"array<{SPAN}>")
    out = {}
    for kind, _, pattern in KINDS:
        found = _found(text, pattern)
        check = CHECKS[kind]
        if check is not None:
            found = F.filter(found, _checked(check))
        out[kind] = F.when(may[kind], found).otherwise(none)
    return out


#: Words that name the value after them, and words that number one.
LABELS = ("account", "acct", "api_key", "apikey", "auth", "card", "credential", "iban", "id", "key", "login", "passport", "passwd", "password", "phone", "pin", "secret", "serial", "ssn", "tax", "token", "user")
NUMBER = ("no", "nr", "num", "number")
#: What is taken off a candidate at either side.
LEADING, TRAILING = "\"'([{<=:,;#$%&*|~", "\"')]}>,;:.!?#$%&*|~"
_W, _S = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"
#: The last word of a text, the one before it and the first, each in linear time.
LAST, LAST_BUT_ONE, NEXT = rf"(?<!{_W})({_W}++){_S}*+\z", rf"(?<!{_W})({_W}++){_S}++{_W}++{_S}*+\z", rf"^{_S}*+({_W}++)"
#: A label that is written in one word with its value.
INNER = r"^[A-Za-z_][A-Za-z_-]*+[=:](?!/)[\"'(\[]*+"
SHORTEST_SHAPE, LONGEST_SHAPE = 8, 64


def _entity(token: Column) -> Column:
    """Whether a word is, or belongs to, an entity of a base kind."""
    ip = F.regexp_extract(token, KINDS[1][2], 0)
    card = F.when(F.length(_digits(token)).between(13, 19), _luhn(token)).otherwise(F.lit(False))
    return (F.contains(token, F.lit("@")) & token.rlike(KINDS[0][2])) | ((ip != "") & _octets(ip)) | card | token.rlike(r"^\+[0-9]")


def _refused(token: Column, core: Column) -> Column:
    """Whether a word has the form of a card or an address and fails the check. Of words that are entities this is not asked."""
    return core.rlike("^[0-9](?:-?[0-9]){12,18}+$") | (F.regexp_extract(token, KINDS[1][2], 0) != "")


def _letters(word: Column) -> Column:
    return F.regexp_replace(word, "[^a-z_]+", "")


def _label(before: Column, two: Column) -> Column:
    """The word that introduces a value, '' if none does."""
    bare = F.when(before.rlike("^[=:]+$"), two).otherwise(before)
    own = _letters(bare)
    named = F.when(own.isin(*NUMBER), _letters(two)).otherwise(own)
    return F.when(before.rlike("[=:][\"'(\\[]*+$"), named).otherwise(F.lit(""))


def _shape(core: Column) -> Column:
    """Digits as 9, runs of letters as a; mixed runs by their length alone."""
    mixed = core.rlike(r"^(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{12,}+$")
    plain = F.regexp_replace(F.regexp_replace(core, "[0-9]", "9"), "[A-Za-z]+", "a")
    return F.when(mixed | (F.length(core) > LONGEST_SHAPE), F.concat(F.lit("x"), F.length(core).cast("string"))).otherwise(plain)


def candidates(text: Column) -> tuple:
    """What stands between candidates, candidates, and how one becomes offsets, value, patterns and whether it is a base entity or a seed.

    Words that are candidates themselves are no context.
    """
    gaps = F.split(text, CANDIDATE, -1)
    spans = _found(text, CANDIDATE)

    def parts(x: Column, i: Column) -> Column:
        right = F.ltrim(x["t"], F.lit(LEADING))
        inner = F.regexp_extract(right, INNER, 0)
        core = F.rtrim(F.substring(right, F.length(inner) + 1, F.length(right)), F.lit(TRAILING))
        left = F.get(F.col("gaps"), i)
        last = F.lower(F.regexp_extract(left, LAST, 1))
        within = inner != ""
        before = F.when(within, F.lower(inner)).otherwise(last)
        two = F.when(within, last).otherwise(F.lower(F.regexp_extract(left, LAST_BUT_ONE, 1)))
        after = F.lower(F.regexp_extract(F.get(F.col("gaps"), i + 1), NEXT, 1))
        start = x["s"] + F.length(x["t"]) - F.length(right) + F.length(inner)
        return F.struct(start.alias("s"), core.alias("core"), before.alias("before"), two.alias("two"), after.alias("after"), _label(before, two).alias("label"), _entity(x["t"]).alias("base"), _refused(x["t"], core).alias("refused"))

    def one(y: Column) -> Column:
        patterns = F.array_compact(F.array(
            F.when((y["before"] != "") & (y["two"] != ""), F.xxhash64(F.lit("L"), y["two"], y["before"])),
            F.when((y["before"] != "") & (y["after"] != ""), F.xxhash64(F.lit("B"), y["before"], y["after"])),
            F.when(y["label"] != "", F.xxhash64(F.lit("N"), y["label"])),
            F.when(F.length(y["core"]) >= SHORTEST_SHAPE, F.xxhash64(F.lit("S"), _shape(y["core"]))),
        ))
        seed = y["base"] | y["label"].isin(*LABELS)
        return F.struct(y["s"].alias("s"), (y["s"] + F.length(y["core"])).alias("e"), F.xxhash64(F.lower(y["core"])).alias("value"), patterns.alias("patterns"), y["base"].alias("base"), seed.alias("seed"), (y["refused"] & ~seed).alias("refused"))

    return gaps, spans, parts, one


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rid, doc_id, an array of spans for each kind, and cand: candidates with their patterns. No text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    base = base_spans(F.col("text"))
    gaps, spans, parts, one = candidates(F.col("text"))
    may = F.col("text").rlike("[0-9@]")
    none = "array<struct<s:int,e:int,value:bigint,patterns:array<bigint>,base:boolean,seed:boolean,refused:boolean>>"
    rows = rows.withColumn("gaps", F.when(may, gaps)).withColumn("found", F.when(may, spans)).withColumn("parts", F.transform("found", parts))
    cand = F.coalesce(F.transform(F.filter("parts", lambda y: y["core"] != ""), one), F.array().cast(none))
    return rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", *(c.alias(k) for k, c in base.items()), cand.alias("cand"), F.xxhash64("text").alias("text_hash"))


def _all_base() -> Column:
    return F.concat(*(F.col(k) for k, _, _ in KINDS))


def contextual_spans(scanned: DataFrame, scratch: Scratch, *, rounds: int = 3, support: int = 3, confidence: float = 0.75, settled: float = 0.02) -> DataFrame:
    """(rid, s, e) of candidates that strong patterns mark. scanned must be a written table."""
    each = scratch.save(scanned.filter(F.size("cand") > 0).select("rid", F.inline("cand")))
    # Distinct pairs; a value is a seed, a base entity or refused if any of its occurrences is.
    edges = each.select(F.explode("patterns").alias("pattern"), "value", "seed", "base", "refused").groupBy("pattern", "value").agg(*(F.max(c).alias(c) for c in ("seed", "base", "refused")))
    edges = scratch.save(edges)
    count = lambda c: F.sum(F.col(c).cast("long"))
    # Patterns that have something to find and values enough; so far each has the support of its seeds.
    able = edges.groupBy("pattern").agg(count("seed").alias("seeds"), count("base").alias("known"), F.count(F.lit(1)).alias("degree")).filter((F.col("degree") >= support) & (F.col("degree") > F.col("known")))
    able = scratch.save(able.select("pattern", "seeds"))
    admitted = scratch.save(able.filter(F.col("seeds") >= support).select("pattern"))
    live, score, strength, done, old = None, None, None, 0, ()
    while True:
        if live is None:  # the edges of admitted patterns, and what their values score
            live = scratch.save(edges.join(admitted, "pattern", "left_semi").select("pattern", "value", "seed", "refused"))
        start = F.when(F.col("seed"), 1.0).otherwise(0.0)
        now = live.withColumn("score", start) if score is None else live.join(score, "value", "left").withColumn("score", F.coalesce("score", start))
        mean = now.groupBy("pattern").agg(F.round(F.sum("score") / (F.count(F.lit(1)) + F.lit(1.0)), 9).alias("strength"))
        new = scratch.save(mean if strength is None else mean.join(strength.withColumnRenamed("strength", "before"), "pattern", "left"))
        # A value is a seed, or refused, everywhere if it is so in one place.
        risen = live.join(new.select("pattern", "strength"), "pattern").groupBy("value").agg(F.round(F.avg("strength"), 9).alias("risen"), F.max("seed").alias("seed"), F.max("refused").alias("refused"))
        risen = scratch.save(risen.select("value", F.when(F.col("seed"), 1.0).when(F.col("refused"), 0.0).otherwise(F.col("risen")).alias("score")))
        moved = 1.0 if strength is None else new.agg(F.max(F.abs(F.col("strength") - F.coalesce("before", F.lit(0.0))))).first()[0] or 0.0
        scratch.drop(*old)
        old, score, strength, done = (risen, new), risen, new.select("pattern", "strength"), done + 1
        # What has been found supports further patterns, as seeds do.
        found = risen.filter(F.col("score") >= confidence).select("value")
        extra = edges.filter(~F.col("seed")).join(found, "value", "left_semi").groupBy("pattern").agg(F.count(F.lit(1)).alias("found"))
        more = able.join(extra, "pattern").filter(F.col("seeds") + F.col("found") >= support).select("pattern")
        more = scratch.save(more.join(admitted, "pattern", "left_anti"))
        if not more.isEmpty():
            admitted, live = scratch.save(admitted.unionByName(more)), None
        elif done >= rounds and moved <= settled:
            break
    strong = scratch.save(strength.filter(F.col("strength") >= confidence).select("pattern"))
    marked = each.filter("not base and not refused").select("rid", "s", "e", F.explode("patterns").alias("pattern")).join(strong, "pattern", "left_semi")
    return marked.select("rid", "s", "e").distinct()


def _joined(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def _labelled(kind: str):
    return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("k"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row for each document: doc_id, text_hash, arrays of spans email, ip, card, phone and ctx."""
    scratch = Scratch(docs.sparkSession, "pii")
    scanned = scratch.save(scan(docs, id_col, text_col))
    ctx = contextual_spans(scanned, scratch, **options)
    per = ctx.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("ctx"))  # the spans of one text
    none = F.array().cast("array<struct<s:int,e:int>>")
    free = F.filter("ctx", lambda x: ~F.exists(_all_base(), lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return scanned.drop("cand").join(scratch.save(per), "rid", "left").withColumn("ctx", F.when(F.col("ctx").isNull(), none).otherwise(free)).drop("rid")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; overlapping spans by the first one's."""
    found = find(docs, id_col, text_col, **options).select("doc_id", "text_hash", *(F.transform(k, _labelled(k)).alias(k) for k in ("email", "ip", "card", "phone", "ctx")))
    spans = F.sort_array(F.concat("email", "ip", "card", "phone", "ctx"))
    some = found.select(F.col("doc_id").alias("_id"), "text_hash", spans.alias("spans")).filter(F.size("spans") > 0).dropDuplicates(["_id", "text_hash"])
    # A row is one column until the end, so no name of its columns matters.
    text = F.col("text")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    may = F.coalesce(text.rlike("[0-9@]"), F.lit(False))
    keyed = rows.filter(may).withColumn("hash", F.xxhash64("text"))
    joined = keyed.join(some, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("text_hash")), "left")

    def step(a: Column, x: Column) -> Column:
        new = x["s"] >= a["at"]
        out = F.when(new, F.concat(a["out"], F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.lit("["), F.upper(x["k"]), F.lit("]"))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), out.alias("out"))

    rest = lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))
    clean = F.when(F.col("spans").isNull(), text).otherwise(F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, rest))
    fields = lambda new: [(new if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns]
    return rows.filter(~may).select(fields(text)).unionByName(joined.select(fields(clean)))


def op4_contextual_pii(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = [k for k, _, _ in KINDS]
    of = {k: _joined(k, F.col(k)) for k in (*base, "ctx")}
    joined = F.array_join(F.concat(*(of[k] for k in base)), ",")
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in base), F.sha2(joined, 256).alias("base_sha256"), F.array_join(F.concat(*of.values()), ",").alias("spans"), F.size("ctx").cast("long").alias("n_ctx"), sum((F.size(k) for k in of), F.lit(0)).cast("long").alias("n_spans"))
