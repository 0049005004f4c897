"""Personal data by fixed rules and by bootstrapped contextual extraction.

The rules find emails, IP addresses, card and phone numbers. Their spans are the seeds: the
words around them are lexical patterns (the two words before; the word before and the word
after). Tokens of at least four digits of the whole corpus are further instances. Patterns
and instances form a graph that is scored in rounds: a pattern by the share of its instances
that are trusted, an instance by the patterns that hold it. Instances of trusted patterns
are added to the spans as kind `id`; spans of the rules stay.

Then the trusted patterns are judged by every token of every text, with or without digits:
those in which less than half of the different tokens are trusted hold ordinary words and go.
Most of them show that on a small part of the texts, and what fails there fails on all, so
they are sifted on growing parts: a pattern that passes one part holds few tokens on the next.
All tokens in the others are looked up, and these patterns are scored again with them.
Tokens trusted by that are spans where they stand in such a pattern; they teach no further
patterns.

DataFrame functions only. A null text is empty. Rows are judged one by one; equal rows get
equal spans. Positions are code points from 0, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.staging import staged, unused_names

# The rules. Starts are tried only where a match can begin and repeats give
# nothing back, which changes no match and keeps long runs of one character linear.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "id")
# Identifier-like: letters, digits and joining marks, with at least four digits.
TOKEN = r"(?<![A-Za-z0-9._/+=-])(?=(?:[A-Za-z._/+=-]*+[0-9]){4})[A-Za-z0-9][A-Za-z0-9._/+=-]*+"
WORD = r"[^\x20\x09-\x0D]+"
# Any token; a piece of a text is a word with the blanks behind it.
ANY_TOKEN = r"(?<![\p{L}\p{M}\p{N}._/+=@-])[\p{L}\p{M}\p{N}._/+=@-]++"
PIECE_START = r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"
MARKS = "._/+=@-"
# Pieces of a text that are looked through as one row.
BLOCK = 256
# A token behind a mark of the same piece.
INNER = r"[^\p{L}\p{M}\p{N}._/+=@\x20\x09-\x0D-][\p{L}\p{M}\p{N}._/+=@-]"
# A piece whose word ends like a token: the word behind a token at its start is the next piece's.
CLOSED = r"[\p{L}\p{M}\p{N}][\x20\x09-\x0D]*\z"
# Places of the filter of sought words, a power of two: 32 KB for any number of patterns.
BITS = 1 << 18

ROUNDS = 3
# A pattern needs this many distinct trusted instances, and this share of its instances.
MIN_SUPPORT = 5
PATTERN_TRUST = 0.8
# An instance is taken up from this chance that at least one of its patterns is right.
INSTANCE_TRUST = 0.9
# A trusted pattern is looked up if this share of all different tokens in it is trusted so far.
HALF_KNOWN = 0.5
# Patterns are sifted on one in so many texts, in this order, before all texts are looked through.
SIFTING = (32_768, 4_096, 512, 64, 8)
# Parts of fewer texts than this are left out; parts from this one on are cut out of all texts once.
SIFTED_TEXTS = 64
SMALL_PART = 64
# Code points looked at on each side of a span for its neighbouring words.
CONTEXT = 80


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(match, r"\."), lambda p: (F.length(part(p)) < 4) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        def doubled(i: Column) -> Column:
            digit = F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int")
            twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
            return F.when(i % 2 == 1, twice).otherwise(digit)

        luhn = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda total, i: total + doubled(i))
        return F.when(F.length(digits).between(14, 19), luhn % 10 == 0).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _located(found: Column, pieces: Column) -> Column:
    """(start, end, value) of each match, from the matches and the text between them."""
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    seed = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["piece"])
        end = start + F.length(pair["match"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(state["spans"], span).alias("spans"))

    pairs = F.zip_with(found, F.slice(pieces, F.lit(1), F.size(found)), lambda m, p: F.struct(p.alias("piece"), m.alias("match")))
    return F.aggregate(pairs, seed, step, lambda state: state["spans"])


def _with_spans(texts: DataFrame) -> DataFrame:
    """Adds base (the rules' spans in order) and others (identifier-like tokens outside them).

    Both are null in texts without a digit or @, which is most of them.
    """
    rules = PATTERNS | {"token": TOKEN}
    needs = {"email": "%@%", "phone": "%+%"}
    df = texts.withColumn("text", F.coalesce("text", F.lit("")))
    digit = F.col("text").rlike("[0-9]")
    found = {
        k: F.when(F.col("text").like(needs[k]) if k in needs else digit, _matches(F.col("text"), p)) for k, p in rules.items()
    }
    df = df.withColumns({f"{k}_found": found[k] for k in rules})
    df = df.withColumns({
        f"{k}_pieces": F.when(F.size(f"{k}_found") > 0, F.split("text", p, -1)) for k, p in rules.items()
    })
    df = df.withColumns({
        f"{k}_at": F.when(F.size(f"{k}_found") > 0, _located(F.col(f"{k}_found"), F.col(f"{k}_pieces"))) for k in rules
    })
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def ranked(number: int, kind: str) -> Column:
        spans = F.filter(F.col(f"{kind}_at"), lambda s: _valid(kind, s["value"]))
        shaped = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
        return F.coalesce(shaped, none)

    df = df.withColumn("base", F.sort_array(F.concat(*[ranked(i, k) for i, k in enumerate(PATTERNS)])))
    trimmed = F.transform(
        F.col("token_at"),
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(len(PATTERNS)).alias("kind"),
            (s["start"] + F.length(F.rtrim(s["value"], F.lit("._/+=-")))).cast("int").alias("end"),
            F.rtrim(s["value"], F.lit("._/+=-")).alias("value"),
        ),
    )
    outside = F.filter(trimmed, lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return df.withColumn("others", F.coalesce(outside, none)).drop(*[f"{k}_{x}" for k in rules for x in ("found", "pieces", "at")])


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[0-9]", "0")


def _contexts(text: Column, span: Column) -> Column:
    """The lexical patterns that a span stands in."""
    before = F.substring(text, F.greatest(span["start"] - CONTEXT, F.lit(0)) + 1, F.least(span["start"], F.lit(CONTEXT)))
    after = F.substring(text, span["end"] + 1, F.lit(CONTEXT))
    # A token cut short by the window is no word; three pieces suffice for two whole ones.
    left = F.filter(F.split(_plain(before), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    right = F.regexp_extract(_plain(after), WORD, 0)
    two = F.concat_ws(" ", F.slice(left, F.greatest(F.size(left) - 1, F.lit(1)), F.lit(2)))
    one = F.coalesce(F.try_element_at(left, F.lit(-1)), F.lit(""))
    known = lambda c, ok: F.when(ok, c)
    return F.filter(
        F.array(
            known(F.concat(F.lit("LL|"), two), F.size(left) >= 2),
            known(F.concat(F.lit("LR|"), one, F.lit(" "), right), (one != "") & (right != "")),
        ),
        lambda c: c.isNotNull(),
    )


def _scored(docs: DataFrame) -> DataFrame:
    """Every row's key, base spans and other tokens, each with its patterns; written without texts."""
    df = _with_spans(docs.select("doc_id", "text")).withColumn("text_key", F.xxhash64("text"))

    def held(spans: str) -> Column:
        return F.transform(
            F.col(spans),
            lambda s: F.struct(s["start"], s["kind"], s["end"], F.xxhash64(s["value"]).alias("instance"), _contexts(F.col("text"), s).alias("patterns")),
        )

    return df.select("doc_id", "text_key", held("base").alias("base"), held("others").alias("others"))


def _graph(rows: DataFrame) -> DataFrame:
    """(pattern, instance, seed): distinct edges."""
    spans = rows.filter("size(base) + size(others) > 0").select(F.explode(F.concat("base", "others")).alias("s"))
    edges = spans.select(
        F.explode("s.patterns").alias("pattern"), F.col("s.instance").alias("instance"), (F.col("s.kind") < len(PATTERNS)).alias("seed")
    )
    return edges.groupBy(F.xxhash64("pattern").alias("pattern"), "instance").agg(F.max("seed").alias("seed"))


def _weights(edges: DataFrame, trust: DataFrame) -> DataFrame:
    """(pattern, weight) of the patterns that are trusted."""
    seen = edges.join(trust, "instance", "left").withColumn("trust", F.coalesce("trust", F.lit(0.0)))
    return seen.groupBy("pattern").agg(
        F.avg("trust").alias("weight"), F.sum((F.col("trust") >= INSTANCE_TRUST).cast("int")).alias("support")
    ).filter((F.col("support") >= MIN_SUPPORT) & (F.col("weight") >= PATTERN_TRUST)).select("pattern", "weight")


def _trust(edges: DataFrame) -> DataFrame:
    """(instance, trust) after all rounds over (pattern, instance, seed)."""
    seeds = edges.filter("seed").select("instance").distinct().withColumn("trust", F.lit(1.0))
    trust = seeds
    for _ in range(ROUNDS):
        missed = F.exp(F.sum(F.log(F.greatest(1 - F.col("weight"), F.lit(1e-6)))))
        scores = edges.join(_weights(edges, trust), "pattern").groupBy("instance").agg((1 - missed).alias("trust"))
        trust = staged(scores.union(seeds).groupBy("instance").agg(F.max("trust").alias("trust")), "pii-trust")
    return trust


def trusted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(instance) that no rule found and that trusted patterns hold, and the edges of the trusted patterns."""
    edges = staged(_graph(rows), "pii-graph")
    trust = _trust(edges)
    seeds = edges.filter("seed").select("instance").distinct()
    known = staged(trust.filter(F.col("trust") >= INSTANCE_TRUST).select("instance"), "pii-known")
    held = edges.join(_weights(edges, trust).select("pattern"), "pattern", "left_semi")
    held = held.join(known.withColumn("is_known", F.lit(True)), "instance", "left")
    held = held.select("pattern", "instance", F.coalesce("is_known", F.lit(False)).alias("seed"))
    return known.join(seeds, "instance", "left_anti"), staged(held, "pii-held")


def _marks(numbers: DataFrame) -> Column:
    """Which of BITS places the numbers fall on, as an array of 64-bit words; its size does not depend on them."""
    words = [0] * (BITS // 64)
    for (n,) in numbers.toDF("n").select(F.col("n").bitwiseAND(BITS - 1)).distinct().collect():
        words[n >> 6] |= 1 << (n & 63)
    signed = [w - (1 << 64) if w >> 63 else w for w in words]
    return F.split(F.lit(",".join(map(str, signed))), ",").cast("array<bigint>")


def _marked(marks: Column, number: Column) -> Column:
    place = F.shiftright(number.bitwiseAND(BITS - 1), 6).cast("int")
    return F.getbit(F.element_at(marks, place + 1), number.bitwiseAND(63).cast("int")) == 1


def _pieces(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pieces of all texts where one of the patterns may stand, each with the two before it, the one behind it and its place.

    Pieces are sifted inside the arrays by the words around them; only those that pass
    become rows. Texts are cut into blocks, so that places are added up over a bounded number of pieces.
    """
    words = texts.select(F.col("text").startswith("LL|").alias("ll"), F.split(F.substring("text", 4, 1 << 30), " ").alias("w"))
    pair = lambda a, b: F.xxhash64(a, b)
    both = pair(F.xxhash64(F.col("w")[0]), F.xxhash64(F.col("w")[1]))
    two = _marks(words.filter("ll").select(both))
    one = _marks(words.filter("NOT ll").select(F.xxhash64(F.col("w")[0])))
    around = _marks(words.filter("NOT ll").select(both))

    def places(lengths: Column) -> Column:
        """The sums before every length."""
        seed = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        step = lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["all"], s["at"]).alias("all"))
        return F.aggregate(lengths, seed, step, lambda s: s["all"])

    def at(array: str, n: Column, other: str | int | bool) -> Column:
        return F.coalesce(F.try_element_at(F.col(array), F.when(n > 0, n)), F.lit(other))

    def leads(h: Column, i: Column) -> Column:
        """May a token stand at the start of the piece behind word i, which has the hash h?"""
        fits = _marked(around, pair(h, at("hashes", i + 3, 0))) | ~at("pieces", i + 2, "").rlike(CLOSED)
        return _marked(one, h) & fits | _marked(two, pair(at("hashes", i, 0), h))

    text = F.coalesce("text", F.lit(""))
    split = docs.select(
        "doc_id", F.xxhash64(text).alias("text_key"), F.split(text, PIECE_START, -1).alias("pieces"),
        F.transform(F.split(_plain(text), r"[\x20\x09-\x0D]+", -1), lambda w: F.xxhash64(w)).alias("hashes"),
    )
    split = split.select(
        "doc_id", "text_key", "pieces",
        # May a token stand behind this word, or in this piece behind a mark or near a long word?
        F.transform("hashes", leads).alias("leads"),
        F.transform("pieces", lambda p: F.length(p) >= CONTEXT // 2).alias("long"),
        F.transform("pieces", lambda p: p.rlike(INNER)).alias("inner"),
    )
    split = split.withColumn("any_long", F.array_contains("long", True))
    numbers = F.sequence(F.lit(0), F.floor((F.size("pieces") - 1) / BLOCK).cast("int"))

    def block(b: Column) -> Column:
        first = F.greatest(b * BLOCK - 2, F.lit(0))
        taken = b * BLOCK - first + BLOCK + 1
        parts = [F.slice(c, first + 1, taken).alias(c) for c in ("pieces", "leads", "long", "inner")]
        length = F.length(F.array_join(F.slice("pieces", b * BLOCK + 1, F.lit(BLOCK)), ""))
        return F.struct((b * BLOCK - first).alias("lead"), *parts, length.alias("length"))

    blocks = split.select("doc_id", "text_key", "any_long", F.transform(numbers, block).alias("blocks"))
    zipped = F.arrays_zip("blocks", places(F.col("blocks.length")).alias("starts"))
    blocks = blocks.select("doc_id", "text_key", "any_long", F.explode(zipped).alias("z"))
    blocks = blocks.select("doc_id", "text_key", "any_long", "z.blocks.*", F.col("z.starts").alias("start"))
    last = F.least(F.size("pieces") - F.col("lead"), F.lit(BLOCK))

    def may_stand(i: Column) -> Column:
        n = F.col("lead") + i + 1
        near_long = at("long", n - 2, False) | at("long", n - 1, False) | at("long", n, False) | at("long", n + 1, False)
        return at("leads", n - 1, False) | F.element_at("inner", n) | (F.col("any_long") & near_long)

    def near(i: Column) -> Column:
        n = F.col("lead") + i + 1
        return F.struct(
            F.concat(at("pieces", n - 2, ""), at("pieces", n - 1, "")).alias("before"), F.element_at("pieces", n).alias("own"),
            at("pieces", n + 1, "").alias("right"),
            (F.col("start") + F.length(F.array_join(F.slice("pieces", F.col("lead") + 1, i), ""))).alias("place"),
        )

    hits = F.filter(F.sequence(F.lit(0), last - 1), may_stand)
    return blocks.select("doc_id", "text_key", F.explode(F.transform(hits, near)).alias("p")).select("doc_id", "text_key", "p.*")


def _pattern_texts(rows: DataFrame, held: DataFrame) -> DataFrame:
    """(pattern, text) of the patterns whose edges are held."""
    spans = rows.filter("size(base) + size(others) > 0").select(F.explode(F.concat("base", "others")).alias("s"))
    texts = spans.select(F.explode("s.patterns").alias("text")).withColumn("pattern", F.xxhash64("text"))
    return staged(texts.join(held.select("pattern"), "pattern", "left_semi").distinct(), "pii-contexts")


def _standing(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, text_key, start, end, instance, pattern) of all tokens of the documents that stand in one of the patterns."""
    pieces = _pieces(docs, texts).withColumns({
        "local": F.concat("before", "own", "right"), "at": F.length("before"), "from": F.col("place") - F.length("before"),
        "found": _matches(F.col("own"), ANY_TOKEN),
    })
    tokens = pieces.select("*", F.explode(_located(F.col("found"), F.split("own", ANY_TOKEN, -1))).alias("s"))
    value = F.rtrim(F.col("s.value"), F.lit(MARKS))
    tokens = tokens.withColumn("value", value).filter(F.length("value") > 0)
    place = F.col("at") + F.col("s.start")
    span = F.struct(place.alias("start"), (place + F.length("value")).alias("end"))
    start = F.col("from") + place
    # Of a token's patterns, only those that may be sought become rows.
    sought = _marks(texts.select("pattern"))
    numbers = F.transform(_contexts(F.col("local"), span), lambda c: F.xxhash64(c))
    edges = tokens.select(
        "doc_id", "text_key", start.alias("start"), (start + F.length("value")).alias("end"),
        F.xxhash64("value").alias("instance"), F.explode(F.filter(numbers, lambda n: _marked(sought, n))).alias("pattern"),
    )
    return edges.join(texts.select("pattern"), "pattern", "left_semi")


def _half_known(held: DataFrame, found: DataFrame) -> DataFrame:
    """(pattern): those in which at least HALF_KNOWN of the different tokens are trusted."""
    pairs = found.select("pattern", "instance", F.lit(False).alias("known"))
    pairs = pairs.union(held.select("pattern", "instance", F.col("seed").alias("known")))
    each = pairs.groupBy("pattern", "instance").agg(F.max("known").alias("known"))
    shares = each.groupBy("pattern").agg(F.avg(F.col("known").cast("int")).alias("share"))
    return shares.filter(F.col("share") >= HALF_KNOWN).select("pattern")


def _standing_judged(docs: DataFrame, rows: DataFrame, held: DataFrame) -> DataFrame | None:
    """(doc_id, text_key, start, end, instance, pattern) of all tokens in the patterns that are half known; None without such patterns.

    A pattern that fails on some of the texts fails on all of them, as the trusted tokens it
    holds are counted over the whole corpus from the start and the others only grow in
    number. So growing shares of the texts sift the patterns before all texts are cut up: this
    changes no result, and the patterns that are left hold few tokens for each trusted one.
    The first share has a bounded number of texts, and each holds the one before, so the tokens
    looked at grow with the trusted ones and not with the texts times the patterns.
    """
    texts = _pattern_texts(rows, held)
    size = rows.count()
    number = F.xxhash64("doc_id", "text")
    small = None
    for part in (part for part in SIFTING if size >= part * SIFTED_TEXTS):
        if held.isEmpty():
            return None
        if part >= SMALL_PART and small is None:
            small = staged(docs.select("doc_id", "text").filter(F.pmod(number, F.lit(SMALL_PART)) == 0), "pii-some")
        some = (docs if part < SMALL_PART else small).filter(F.pmod(number, F.lit(part)) == 0)
        found = _standing(some, texts).select("pattern", "instance")
        held = staged(held.join(_half_known(held, found), "pattern", "left_semi"), "pii-sifted")
        texts = staged(texts.join(held.select("pattern"), "pattern", "left_semi"), "pii-contexts")
    if held.isEmpty():
        return None
    edges = staged(_standing(docs, texts).distinct(), "pii-standing")
    patterns = staged(_half_known(held, edges), "pii-judged")
    return None if patterns.isEmpty() else edges.join(patterns, "pattern", "left_semi")


def looked_up(docs: DataFrame, rows: DataFrame, held: DataFrame) -> DataFrame | None:
    """(doc_id, text_key, start, kind, end) of all further tokens that trusted patterns hold; None without such patterns.

    held has the patterns' edges so far.
    """
    edges = _standing_judged(docs, rows, held)
    if edges is None:
        return None
    held = held.join(edges.select("pattern").distinct(), "pattern", "left_semi")
    # Tokens that meet a span already judged, by the rules or as an instance, are no others.
    judged = rows.filter("size(base) + size(others) > 0").select(
        F.col("doc_id").alias("of"), F.col("text_key").alias("of_key"), F.concat("base", "others").alias("judged")
    ).dropDuplicates(["of", "of_key"])
    edges = edges.join(judged, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key")), "left")
    meets = F.exists("judged", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"]))
    edges = staged(edges.filter(~F.coalesce(meets, F.lit(False))).drop("judged", "of", "of_key"), "pii-looked-up")

    further = edges.select("pattern", "instance", F.lit(False).alias("seed"))
    graph = held.union(further).groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    graph = staged(graph, "pii-all-edges")
    trust = _trust(graph)
    sure = trust.filter(F.col("trust") >= INSTANCE_TRUST).select("instance")
    standing = edges.join(_weights(graph, trust).select("pattern"), "pattern", "left_semi").join(sure, "instance", "left_semi")
    return standing.select("doc_id", "text_key", "start", F.lit(len(PATTERNS)).alias("kind"), "end")


def _listed(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.concat_ws(
        ",",
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))),
    )


def _all_spans(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds all: the rules' and the found spans, in order. Equal rows stay as many as they are."""
    instances, held = trusted(rows)
    tokens = rows.filter("size(others) > 0").select("doc_id", "text_key", F.explode("others").alias("s"))
    taken = tokens.join(instances.withColumnRenamed("instance", "known"), F.col("s.instance") == F.col("known"))
    taken = taken.select("doc_id", "text_key", "s.start", "s.kind", "s.end")
    further = None if held.isEmpty() else looked_up(docs, rows, held)
    if further is not None:
        taken = taken.union(further)
    found = taken.groupBy(F.col("doc_id").alias("of"), F.col("text_key").alias("of_key")).agg(
        F.collect_set(F.struct("start", "kind", "end")).alias("found")
    )
    bare = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key")), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return joined.withColumn("base", bare).withColumn(
        "all", F.sort_array(F.concat("base", F.coalesce("found", none)))
    ).select("doc_id", "text_key", "base", "all")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts per rule, base_sha256, spans, n_found: a row per input row."""
    rows = _all_spans(docs, staged(_scored(docs), "pii-spans"))

    def count(number: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(PATTERNS)]
    return rows.select(
        "doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("all")).alias("spans"),
        (F.size("all") - F.size("base")).cast("long").alias("n_found"),
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    kind = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    seed = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, s: Column) -> Column:
        between = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        grown = F.concat(state["parts"], F.array(between, F.element_at(kind, s["kind"] + 1)))
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], grown).otherwise(state["parts"]).alias("parts")
        )

    done = F.aggregate(spans, seed, step)
    rest = F.substring(text, done["at"] + 1, F.length(text))
    return F.concat(F.array_join(done["parts"], ""), rest)


def masked_documents(docs: DataFrame) -> DataFrame:
    """All documents, personal data masked, with the columns of the input."""
    spans = _all_spans(docs, staged(_scored(docs), "pii-spans")).filter("size(all) > 0")
    # Names that the documents do not have, whatever their columns are called.
    of, of_key, of_spans = unused_names(docs, "pii_id", "pii_key", "pii_spans")
    spans = spans.groupBy(F.col("doc_id").alias(of), F.col("text_key").alias(of_key)).agg(F.max("all").alias(of_spans))
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(F.col(of)) & (key == F.col(of_key)), "left")
    found = F.col(of_spans)
    text = F.when(found.isNotNull(), masked(docs["text"], found)).otherwise(docs["text"])
    return joined.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns])
