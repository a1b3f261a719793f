"""Personal data: fixed patterns plus bootstrapped context patterns, all native.

Base spans come from four expressions. They seed a bootstrap over all different
texts of the corpus, with secrets (keys and tokens of well-known forms behind a =
or :) as a fifth kind. Every word with a digit or an @ is an occurrence. It has an
instance (the identifier that starts there: a base span, or the word with the
groups of digits that follow it) and lexical patterns: the two words before it, the
word before it, and the word after it; earlier and later words with digits count by
their shape, the ends of the text as ^ and $. Rounds of
aggregation over the distinct pattern-instance edges score patterns by the share
of their instances known for a kind, and instances by the patterns that accept
them, if they could be of that kind at all (``_plausible``); accepted instances
are known in the next round, whatever their form. Occurrences that an accepted
pattern finds at an accepted instance, outside base spans, become spans of the
pattern's kind.

The expressions are the specified ones made linear: runs are possessive, and a
match starts at the end of the match before or at the start of its run, where
the leftmost match must start. Offsets are running totals by doubling, and spans
are looked up by halving, so a text of n matches takes about n log n steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierscope.llm import common

KINDS = ["email", "ip", "card", "phone"]
#: What the bootstrap knows besides; it has no base spans.
ALL_KINDS = [*KINDS, "secret"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9][\x20-]?[0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A token; what it captures is up to 19 groups of digits that follow it. No
#: identifier has more than 19 digits, so none is cut.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?=((?:\x20[(]?[0-9][().0-9-]*+(?![^\s,;:!?\"'\]>])){0,19}+))"
#: Forms that an identifier may have, far looser than the base expressions.
LOOSE = {
    "email": r"^[^\s@]+@[^\s@]+$",
    "ip": r"^([0-9]+([.][0-9]+){3}(:[0-9]+)?|[0-9a-f]{0,4}(:[0-9a-f]{0,4}){2,7})(/[0-9]+)?$",
    "card": r"^[0-9][0-9 .-]*$",
    "phone": r"^[+(]*[0-9][0-9 ().+/-]*$",
    "secret": r"^(?=.*\p{L})(?=.*[0-9])[\p{L}0-9+/_.=-]{16,}$",
}
DIGITS = {"card": (12, 19), "phone": (7, 15)}
#: Forms of keys that seed the secrets, where the word before ends in = or :
SECRET = r"^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[a-z]{2,4}[-_][0-9a-z_-]{20,}|akia[0-9a-z]{16})$"
#: A pattern needs this many known instances, and this share of all its instances;
#: patterns of a single word need the higher share.
SUPPORT, CONFIDENCE, STRONG, ROUNDS = 3, 0.6, 0.9, 3
SPANS = "array<struct<start:int,k:int,end:int>>"
TOKENS = "array<struct<start:int,end:int,token:string,more:string,before:array<string>,after:string>>"


def _let(x: Column, f) -> Column:
    """f(x) with x evaluated once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _running(values: Column, add) -> Column:
    """Running totals of an array of ints by ``add``, in log n passes."""
    kind = "array<int>"
    n = F.size(values)
    steps = F.when(n > 1, F.transform(F.sequence(F.lit(0), F.floor(F.log2(n - 1)).cast("int")), lambda k: F.call_function("shiftleft", F.lit(1), k))).otherwise(F.array().cast(kind))
    return F.aggregate(steps, values.cast(kind), lambda acc, k: F.transform(acc, lambda x, i: F.when(i >= k, add(x, F.get(acc, i - k))).otherwise(x)).cast(kind))


def _matches(text: Column, pattern: str, groups: int = 0) -> Column:
    """array<struct<start, end, token, gap, more>> of all matches, by code points;
    gap: the text since the match before; more: the first group, if there is one."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("token"), F.regexp_extract_all(text, F.lit(pattern), F.lit(groups)).alias("more"))

    def placed(pairs: Column) -> Column:
        lengths = F.transform(pairs, lambda x: F.length(x["gap"]) + F.length(x["token"]))
        ends = _running(lengths, lambda x, y: x + y)
        return _let(ends, lambda e: F.transform(pairs, lambda x, i: F.struct((F.get(e, i) - F.length(x["token"])).alias("start"), F.get(e, i).alias("end"), x["token"].alias("token"), x["gap"].alias("gap"), x["more"].alias("more"))))

    return _let(F.filter(parts, lambda x: x["token"].isNotNull()), placed)


def _valid(kind: str, x: Column) -> Column:
    digits = F.regexp_replace(x["token"], "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":

        def small(p: Column) -> Column:
            p = F.ltrim(p, F.lit("0"))
            return F.when(F.length(p) <= 3, F.concat(F.lit("0"), p).cast("int") <= 255).otherwise(F.lit(False))

        return F.forall(F.split(x["token"], r"\."), small)
    if kind == "card":

        def add(acc: Column, i: Column) -> Column:
            d = F.substring(digits, i, F.lit(1)).cast("int")
            twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
            return acc + F.when((n - i) % 2 == 1, twice).otherwise(d)

        luhn = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0
        return F.when(n.between(14, 19), luhn).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _base(text: Column) -> Column:
    """All base spans of a text: array<struct<start, kind number, end>>, sorted."""
    quick = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    parts = []

    def spans_of(k: int, name: str) -> Column:
        found = F.filter(_matches(text, PATTERNS[name]), lambda x: _valid(name, x))
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end"))).cast(SPANS)

    for k, name in enumerate(KINDS):
        spans = spans_of(k, name)
        parts.append(F.when(quick[name], spans).otherwise(F.array().cast(SPANS)) if name in quick else spans)
    return F.array_sort(F.concat(*parts))


def _reduced(token: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(token), "[0-9]+", "9"), r"\p{L}+", "a")


def _words(gap: Column) -> Column:
    """Lower-cased words of the text between two tokens."""
    return F.filter(F.split(F.lower(gap), r"\s+", -1), lambda w: w != "")


def _tokens(text: Column) -> Column:
    """All words with a digit or an @: start, end, token, more (the groups of digits
    after it), the two words before it and the word after it, whole."""

    def around(found: Column) -> Column:
        shape = lambda i: F.coalesce(_reduced(F.get(found, i)["token"]), F.lit("^"))
        last = F.slice(F.split(text, TOKEN, -1), F.size(found) + 1, 1)  # the text after the last token
        gaps = F.transform(F.concat(F.transform(found, lambda x: x["gap"]), last), _words)

        def one(g: Column) -> Column:
            def token(x: Column, i: Column) -> Column:
                near, early = F.get(g, i), F.get(g, i - 1)
                before = F.concat(F.when(i > 0, F.coalesce(F.get(early, F.size(early) - 1), shape(i - 2))).otherwise(F.lit("^")), F.lit("\n"), F.when(i > 0, shape(i - 1)).otherwise(F.lit("^")))
                two = F.slice(F.concat(F.split(before, "\n", -1), near), -2, 2)
                then = F.get(g, i + 1)
                after = F.coalesce(F.get(then, F.lit(0)), _reduced(F.get(found, i + 1)["token"]), F.lit("$"))
                return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["token"].alias("token"), x["more"].alias("more"), two.alias("before"), after.alias("after"))

            return F.transform(found, token)

        return _let(gaps, one)

    return _let(_matches(text, TOKEN, 1), around).cast(TOKENS)


def _plausible(instance: Column, kind: Column) -> Column:
    """Whether a text could be an identifier of the kind with this number."""
    n, out = F.length(F.regexp_replace(instance, "[^0-9]", "")), F.lit(False)
    for k, name in enumerate(ALL_KINDS):
        fits = instance.rlike(LOOSE[name])
        out = F.when(kind == k, fits & n.between(*DIGITS[name]) if name in DIGITS else fits).otherwise(out)
    return out


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, t1, t2, base spans and tokens of every row; written."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    src = docs.select(*keep, *common.text_hash(), text.alias("_body"))
    # every span and token has a digit or an @: one cheap look spares most texts
    some = F.col("_body").rlike("[0-9@]")
    base, tokens = _base(F.col("_body")), _tokens(F.col("_body"))
    src = src.select(*keep, "t1", "t2", F.when(some, base).otherwise(F.array().cast(SPANS)).alias("base"), F.when(some, tokens).otherwise(F.array().cast(TOKENS)).alias("tokens"))
    return common.written(src, "pii-scan")


def _below(spans: Column, x: Column) -> Column:
    """How many spans, in order of their starts, start before x; by halving."""
    n = F.size(spans)
    first = F.struct(F.lit(0).alias("lo"), n.alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        right = F.get(spans, mid)["start"] < x
        new = F.struct(F.when(right, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(right, acc["hi"]).otherwise(mid).alias("hi"))
        return F.when(acc["lo"] < acc["hi"], new).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), F.floor(F.log2(n + 1)).cast("int")), first, step, lambda acc: acc["lo"])


def _with(array: Column, names: list[str], **fields) -> tuple[Column, list[str]]:
    """The structs of an array with more fields, each a function of the struct: what a
    step makes is read by later ones and computed once. With the fields' names."""
    new = F.transform(array, lambda x: F.struct(*[x[n].alias(n) for n in names], *[f(x).alias(k) for k, f in fields.items()]))
    return new, [*names, *fields]


def _occurrences(base: Column, tokens: Column) -> Column:
    """array<struct<start, end, instance, k, covered, patterns>> of a text's tokens."""

    def own(x: Column) -> Column:
        return _let(F.get(base, _below(base, x["start"])), lambda span: F.when(span["start"] < x["end"], span))

    def raw(x: Column) -> Column:
        # a group of digits goes on with those after it, unless a base span starts there
        follows = F.coalesce(x["next"] < x["end"] + F.length(x["more"]), F.lit(False))
        number = x["token"].rlike(r"^[+(]*[0-9][().0-9-]*$") & ~x["token"].rlike(r"^[0-9]+([.][0-9]+){3}$")
        whole = F.concat(x["token"], x["more"])
        return F.when(number & ~follows & (F.length(F.regexp_replace(whole, "[^0-9]", "")) <= 19), whole).otherwise(x["token"])

    def body(x: Column) -> Column:
        return F.regexp_replace(F.substring(x["raw"], F.length(x["label"]) + 1, F.length(x["raw"])), r"""^[<"'\[{]+""", "")

    def words(x: Column) -> Column:
        return F.when(x["label"] != "", F.array(F.element_at(x["before"], 2), F.lower(x["label"]))).otherwise(x["before"])

    def instance(x: Column) -> Column:
        span = F.substring(F.concat(x["token"], x["more"]), x["own"]["start"] - x["start"] + 1, x["own"]["end"] - x["own"]["start"])
        return F.lower(F.when(x["own"].isNotNull(), span).otherwise(x["free"]))

    def place(x: Column) -> Column:
        at = x["start"] + F.length(x["raw"]) - F.length(x["body"])
        return F.coalesce(x["own"], F.struct(at.alias("start"), F.lit(None).cast("int").alias("k"), (at + F.length(x["free"])).alias("end")))

    def made(far: Column) -> Column:
        def one(x: Column) -> Column:
            secret = x["instance"].rlike(SECRET) & F.element_at(x["words"], 2).rlike("[=:]$")
            covered = F.coalesce((x["starts"] > 0) & (F.get(far, x["starts"] - 1) > x["place"]["start"]), F.lit(False))
            patterns = F.array(F.concat(F.lit("2 "), F.array_join(x["words"], " ")), F.concat(F.lit("1 "), F.element_at(x["words"], 2)), F.concat(F.lit("r "), x["after"]))
            k = F.coalesce(x["place"]["k"], F.when(secret, F.lit(len(KINDS))))
            return F.struct(x["place"]["start"].alias("start"), x["place"]["end"].alias("end"), x["instance"].alias("instance"), k.alias("k"), covered.alias("covered"), patterns.alias("patterns"))

        return F.transform(rows, one)

    rows, names = _with(tokens, ["start", "end", "token", "more", "before", "after"], own=own, next=lambda x: F.get(base, _below(base, x["end"]))["start"])
    rows, names = _with(rows, names, raw=raw)
    # label=value is a value after the word label=
    rows, names = _with(rows, names, label=lambda x: F.regexp_extract(x["raw"], r"^([\p{L}_.-]+[=:])[\"'<\[{(]*[^=:\s]{4}", 1))
    rows, names = _with(rows, names, body=body)
    rows, names = _with(rows, names, free=lambda x: F.regexp_replace(x["body"], r"[^\p{L}\p{N}]+$", ""))
    rows, names = _with(rows, names, words=words, instance=instance, place=place)
    rows, names = _with(rows, names, starts=lambda x: _below(base, x["place"]["end"]))
    return _let(_running(F.transform(base, lambda s: s["end"]), F.greatest), made)


def discover(scanned: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, strong: float = STRONG, rounds: int = ROUNDS) -> DataFrame:
    """(t1, t2, added): spans per different text that context patterns add.

    Patterns, instances and rows that many edges share are joined by broadcast.
    """
    texts = scanned.where(F.size("tokens") > 0).select("t1", "t2", "base", "tokens").dropDuplicates(["t1", "t2"])
    seen = texts.select("t1", "t2", F.explode(_occurrences(F.col("base"), F.col("tokens"))).alias("o")).select("t1", "t2", "o.*")
    # a token inside a base span that starts in an earlier token is no occurrence
    seen = seen.where("instance <> '' AND (k IS NOT NULL OR NOT covered)")
    seen = common.written(seen.select("t1", "t2", "start", "end", "instance", "k", "covered", F.explode("patterns").alias("pattern")), "pii-seen")
    edges = common.written(seen.groupBy("pattern", "instance").agg(F.max("k").alias("k")), "pii-edges")
    hot = {(df, key): common.hot_keys(d, [key]) for df, d in (("edges", edges), ("seen", seen)) for key in ("pattern", "instance")}
    known = common.written(edges.where("k IS NOT NULL").groupBy("instance").agg(F.min("k").alias("kind")), "pii-known")
    accepted, size = None, known.count()
    for _ in range(rounds):
        graph = common.join_few(edges.select("pattern", "instance"), known, ["instance"], hot=hot["edges", "instance"])
        counts = graph.groupBy("pattern", "kind").agg(F.count("*").alias("n"))
        total = counts.groupBy("pattern").agg(F.sum("n").alias("total"), F.max(F.when(F.col("kind").isNotNull(), F.struct("n", "kind"))).alias("best"))
        least = F.when(F.startswith("pattern", F.lit("2 ")), F.lit(confidence)).otherwise(F.lit(strong))
        accepted = total.where(F.col("best.n") >= support).select("pattern", F.col("best.kind").alias("kind"), (F.col("best.n") / F.col("total")).alias("score")).where(F.col("score") >= least)
        accepted = common.written(accepted, "pii-patterns")
        miss = F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9))))
        met = common.join_few(edges.drop("k"), accepted, ["pattern"], "inner", hot=hot["edges", "pattern"])
        found = met.where(_plausible(F.col("instance"), F.col("kind"))).groupBy("instance", "kind").agg((1 - F.exp(miss)).alias("score"))
        found = found.where(F.col("score") >= confidence).groupBy("instance").agg(F.max(F.struct("score", "kind")).alias("b")).select("instance", F.col("b.kind").alias("kind"))
        known = common.written(known.union(found.join(known, "instance", "left_anti")), "pii-known")
        if size == (size := known.count()):
            break
    new = common.join_few(seen.where("NOT covered"), accepted.withColumnRenamed("kind", "pk").drop("score"), ["pattern"], "inner", hot=hot["seen", "pattern"])
    new = common.join_few(new, known, ["instance"], "inner", hot=hot["seen", "instance"]).where("pk = kind")
    span = F.struct(F.col("start"), F.col("kind").alias("k"), F.col("end"))
    return new.groupBy("t1", "t2").agg(F.collect_set(span).alias("added"))


def _told(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["k"] + 1), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def _with_added(scanned: DataFrame) -> DataFrame:
    added = common.written(discover(scanned), "pii-added")
    rows = common.join_few(scanned.drop("tokens"), added, ["t1", "t2"])
    return rows.withColumn("all", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(SPANS)))))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans, n_spans (base and
    added ones) and n_added for every row.

    Null texts count as empty: no spans, the digest of the empty string. Equal
    texts get equal spans. Offsets are code points, ends exclusive. Added spans
    are of the four kinds, or secrets.
    """
    out = _with_added(scan(docs, ["doc_id"]))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(len(KINDS))]
    return out.select("doc_id", *counts, F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(F.col("all")).alias("spans"), F.size("all").cast("long").alias("n_spans"), (F.size("all") - F.size("base")).cast("long").alias("n_added"))


def redact(docs: DataFrame) -> DataFrame:
    """The rows of docs, every span replaced by its kind, as in ``<EMAIL>``.

    Overlapping spans become one, named after the first. Rows, order of columns
    and null texts stay; n_chars, where there is one, counts the new text.
    """
    columns = docs.columns
    spans = _with_added(scan(docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in columns])), ["_row"])).select("_row", "all")
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in ALL_KINDS])
    text = F.col("_row")["text"]
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.element_at(names, s["k"] + 1))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    new = F.aggregate("all", first, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    spans = spans.withColumn("_new", F.when((F.size("all") == 0) | text.isNull(), text).otherwise(new))
    take = {"text": F.col("_new"), "n_chars": F.when(F.col("_new").isNotNull(), F.length("_new"))}
    return spans.select(*[take[c].cast(docs.schema[c].dataType).alias(c) if c in take else F.col("_row")[c].alias(c) for c in columns])
