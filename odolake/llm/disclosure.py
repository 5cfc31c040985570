"""Personal data, and terms that give it away: information-theoretic sanitisation.

Fixed patterns find the protected entities (addresses, numbers). Corpus
co-occurrence then tells how strongly the words of an entity's contexts reveal it:
for entity e and term t, ``disclosure = PMI(e, t) / IC(e)``, the share of e's
information content that t carries. A context is a whole document with words of
any length (``context="document"``, as the registered query asks) or a line with
words of four letters and more (the default). ``co`` (both in one context) and
``df`` count distinct documents, so copies of one document count once. SMOOTH documents are
added to the term's: one sighting is weak evidence in a small corpus and strong
in a large one, and no count is too small. A term is generalised from GENERALISE
on and removed from REMOVE on.

Texts are counted where they stand: a text that occurs once is exploded and added
up in its own task; only those whose hash is marked in a bitmap of repeated ones
(fixed size) are first brought together. Within the contexts a term that is too
frequent for any entity of its context is dropped before the two meet. Entities
with the same contexts are one class, as are terms, since all figures are theirs;
pairs are formed of classes, so a list of thousands of addresses costs no product.

Only DataFrame functions run: matches by ``regexp_extract_all``, their places from
the lengths of the matches and of what ``split`` leaves between them. Repetitions
in the patterns are possessive, so that no text makes the matcher backtrack or
recurse deeply; a look-behind or the end of the last match opens a run.

Cases: null and empty texts have no span. Repeated rows give repeated results.
Places are code points, end exclusive. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.keep import keep

KINDS = ("email", "ip", "card", "phone")
TERM, GONE = "term", "gone"

# What a match of each kind looks like.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
_IP_OK = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"

GENERALISE, REMOVE = 0.9, 0.97
SMOOTH = 0.5
"""Documents that a term is taken to stand in besides those counted."""
MARKS = 1 << 24
"""Bits of the bitmap of repeated texts."""
FEW = 64
"""Terms of a context that its words are held against in place; more go by a join."""
BLOCK = 256
"""Words whose places are added up at a time."""
WORDS = {"line": r"\p{L}{4,}", "document": r"\p{L}++"}
"""What a term is, by context."""


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of all matches in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(found.alias("m"), F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("g"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint,match:string>>)").alias("out"))
    walk = F.aggregate(
        pairs,
        zero,
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["g"]) + F.length(p["m"])).alias("at"),
            F.array_append(
                acc["out"],
                F.struct(
                    (acc["at"] + F.length(p["g"])).alias("start"),
                    (acc["at"] + F.length(p["g"]) + F.length(p["m"])).alias("end"),
                    p["m"].alias("match"),
                ),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return walk


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def one(total: Column, i: Column) -> Column:
        v = digits.substr(F.length(digits) - i + 1, F.lit(1)).cast("int")
        v = F.when(i % 2 == 0, v * 2 - F.when(v > 4, 9).otherwise(0)).otherwise(v)
        return total + v

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), one) % 10 == 0


def _kept(kind: str) -> callable:
    def ok(m: Column) -> Column:
        value = m["match"]
        if kind == "ip":
            return value.rlike(_IP_OK)
        if kind == "card":
            d = _digits(value)
            return F.length(d).between(14, 19) & _luhn(d)
        if kind == "phone":
            return F.length(_digits(value)).between(10, 15)
        return F.lit(True)

    return ok


# What a text must hold to have a match of the kind at all.
_HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}


def base_spans(text: Column) -> Column:
    """array<struct<start, n, end, kind, value>> in order of start, then kind."""
    none = F.expr("cast(array() as array<struct<start:bigint,n:int,end:bigint,kind:string,value:string>>)")

    def of(n: int, kind: str) -> Column:
        good = F.filter(matches(text, PATTERNS[kind]), _kept(kind))
        spans = F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(n).alias("n"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["match"].alias("value")))
        return F.when(_HINTS[kind](text), spans).otherwise(none)

    return F.array_sort(F.concat(*(of(n, kind) for n, kind in enumerate(KINDS))))


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumns({"h": F.xxhash64("doc_id", "text"), "d": F.xxhash64("text")})


def _contexts(found: DataFrame, context: str) -> DataFrame:
    """d, line_at, line and the entities of every context that holds one, of distinct texts."""
    hits = found.where(F.size("base") > 0).dropDuplicates(["d"])
    if context == "document":
        entities = F.array_distinct(F.transform("base", lambda s: F.concat(s["kind"], F.lit(":"), F.lower(s["value"]))))
        return hits.select("d", F.lit(0).cast("long").alias("line_at"), F.col("text").alias("line"), entities.alias("entities"))
    hits = hits.withColumn("s", F.explode("base"))
    ahead = F.expr("substring(text, 1, cast(s.start as int))")
    line_at = F.length(ahead) - F.expr("instr(reverse(substring(text, 1, cast(s.start as int))), '\\n')")
    line_at = F.when(F.instr(ahead, "\n") > 0, line_at + 1).otherwise(F.lit(0))
    line_end = F.expr("locate('\\n', text, cast(s.end as int) + 1)")
    lines = hits.select("d", "text", F.concat("s.kind", F.lit(":"), F.lower("s.value")).alias("entity"), line_at.cast("long").alias("line_at"), line_end.alias("line_end"))
    line = F.expr("substring(text, cast(line_at as int) + 1, if(line_end > 0, line_end - 1, length(text)) - cast(line_at as int))")
    return lines.select("d", "line_at", line.alias("line"), "entity").groupBy("d", "line_at", "line").agg(F.collect_set("entity").alias("entities"))


def _marks(keys: DataFrame) -> Column:
    """A dense bitmap of the 64-bit hashes ``d`` of ``keys``, as an array that a plan carries like a constant."""
    at = F.pmod("d", F.lit(MARKS))
    words = keys.select(at.alias("at")).groupBy(F.expr("at div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    dense = keys.sparkSession.range(MARKS // 64).withColumnRenamed("id", "w").join(words, "w", "left").select("w", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "bits"))), lambda x: x["bits"]).alias("bits"))


def _term_counts(rows: DataFrame, word: Column) -> tuple[DataFrame, DataFrame]:
    """(term, df_t) over distinct texts, and total, their number, as a table of one row."""
    copies = keep(rows.groupBy("d").agg(F.count("*").alias("copies")), "copies")
    marks = keep(_marks(copies.where("copies > 1")), "marks")
    at = F.pmod("d", F.lit(MARKS))
    marked = F.getbit(F.get(marks.scalar(), F.expr(f"cast(pmod(d, {MARKS}) div 64 as int)")), (at % 64).cast("int")) == 1
    every = F.array_distinct(F.regexp_extract_all(F.lower("text"), word, F.lit(0)))
    texts = rows.select("d", "text", marked.alias("marked"))
    once = texts.where("not marked").select("text").unionByName(texts.where("marked").select("d", "text").dropDuplicates(["d"]).select("text"))
    return once.select(F.explode(every).alias("term")).groupBy("term").agg(F.count("*").alias("df_t")), copies.agg(F.count("*").alias("total"))


def _classes(pairs: DataFrame, name: str, *carried: str) -> DataFrame:
    """``name`` and the hash of all contexts ``c`` it stands in, with the carried columns: the same for names of the same contexts."""
    hashed = pairs.groupBy(name, *carried).agg(F.count("*").alias("n"), F.sum(F.expr("cast(xxhash64(c) as decimal(38,0))")).alias("s"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("x"))
    return hashed.select(name, *carried, F.struct("n", "s", "x", *carried).alias("class"))


def revealing_terms(rows: DataFrame, found: DataFrame, context: str = "line") -> DataFrame:
    """d, start, end, disclosure of the words that reveal an entity of their context."""
    word = F.lit(WORDS[context])
    contexts = keep(_contexts(found, context).withColumn("c", F.xxhash64("d", "line_at")), "contexts")
    counts, total = _term_counts(rows, word)
    total = keep(total, "total").scalar()

    # Entities: the distinct texts they stand in, and their classes.
    entities = contexts.select("c", "d", F.explode("entities").alias("entity"))
    df_entity = entities.select("entity", "d").distinct().groupBy("entity").agg(F.count("*").alias("df_e"))
    known = entities.select("entity", "c").join(df_entity.where(F.col("df_e") < total), "entity")
    entity_class = _classes(known, "entity", "df_e")
    entity_at = keep(known.join(entity_class, ["entity", "df_e"]).select("c", F.col("class").alias("e")).distinct(), "entity_classes")

    # Terms: none that is too frequent to reach GENERALISE with any entity of its context, as co is df_e at most.
    words = F.regexp_extract_all(F.lower(F.regexp_replace("line", PATTERNS["email"], " ")), word, F.lit(0))
    most = entity_at.groupBy("c").agg(F.max("e.df_e").alias("df_e"))
    rare = F.pow(total.cast("double"), F.lit(1 - GENERALISE)) * F.pow(F.col("df_e").cast("double"), F.lit(GENERALISE)) * (1 + 1e-9)
    spread = contexts.join(most, "c").select("c", rare.alias("rare"), F.explode(F.array_distinct(words)).alias("term"))
    terms = keep(spread.join(counts, "term").where(F.col("df_t") + SMOOTH <= F.col("rare")).select("c", "term", "df_t"), "terms")
    term_class = _classes(terms, "term", "df_t")
    term_at = keep(terms.join(term_class, ["term", "df_t"]).select("c", "term", F.col("class").alias("t")), "term_classes")

    # Classes that meet: co counts distinct texts.
    doc = contexts.select("c", "d")
    met = keep(term_at.select("c", "t").distinct().join(entity_at, "c").join(doc, "c").select("c", "d", "t", "e"), "met")
    co = met.select("t", "e", "d").distinct().groupBy("t", "e").agg(F.count("*").alias("co"))
    carried = F.log2(F.col("co") * total / (F.col("e.df_e") * (F.col("t.df_t") + SMOOTH))) / F.log2(total / F.col("e.df_e"))
    flags = co.withColumn("disclosure", carried).where(F.col("disclosure") >= GENERALISE)
    strongest = met.join(flags, ["t", "e"]).groupBy("c", "t").agg(F.max("disclosure").alias("disclosure"))
    flagged = keep(term_at.join(strongest, ["c", "t"]).select("c", "term", "disclosure"), "flagged")
    return _places(contexts, flagged, WORDS[context])


def _places(contexts: DataFrame, flagged: DataFrame, word: str) -> DataFrame:
    """Where the flagged terms stand: ends of all words are added up in place, then only flagged ones leave their row."""
    wanted = flagged.groupBy("c").agg(F.collect_list("term").alias("terms"))
    rows = contexts.join(wanted, "c").withColumn("words", F.regexp_extract_all("line", F.lit(word), F.lit(0)))
    gaps = F.slice(F.split("line", word, -1), 1, F.size("words"))
    rows = rows.withColumn("steps", F.zip_with(gaps, "words", lambda g, w: (F.length(g) + F.length(w)).cast("long")))
    # Running sums by blocks, so that no array is copied once for each of its elements.
    rows = rows.withColumn("block", F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(F.size("steps"))).cast("int")))
    blocks = F.transform(F.sequence(F.lit(0), F.expr("(greatest(size(steps), 1) - 1) div block")), lambda b: F.slice("steps", (b * F.col("block") + 1).cast("int"), F.col("block")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))

    def sums(steps: Column, at: Column) -> Column:
        first = F.struct(at.alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))
        return F.aggregate(steps, first, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"] + x).alias("out")), lambda acc: acc["out"])

    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda acc, x: acc + x))
    ahead = F.aggregate(totals, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])
    rows = rows.withColumns({"blocks": blocks, "ahead": ahead})
    ends = F.flatten(F.zip_with("blocks", "ahead", sums))
    held = F.zip_with("words", ends, lambda w, e: F.struct(F.lower(w).alias("term"), F.length(w).alias("n"), e.alias("end")))
    some = F.when(F.size("terms") <= FEW, F.filter(held, lambda p: F.array_contains("terms", p["term"]))).otherwise(held)
    places = rows.select("c", "d", "line_at", F.explode(some).alias("p")).select("c", "d", "line_at", "p.term", "p.n", "p.end")
    end = F.col("line_at") + F.col("end")
    return places.join(flagged, ["c", "term"]).select("d", (end - F.col("n")).alias("start"), end.alias("end"), "disclosure")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", context: str = "line") -> DataFrame:
    """doc_id, text, base (spans of the fixed kinds) and terms (start, end, disclosure) of every document."""
    rows = _rows(docs, doc_id, text)
    found = rows.withColumn("base", base_spans(F.col("text")))
    kept = keep(found.select("doc_id", "h", "d", "base", F.when(F.size("base") > 0, F.col("text")).alias("text")), "entities")
    terms = revealing_terms(rows, kept, context).groupBy("d").agg(F.sort_array(F.collect_list(F.struct("start", "end", "disclosure"))).alias("terms"))
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint,disclosure:double>>)")
    # A term inside an entity stays with the entity.
    apart = F.filter(F.coalesce("terms", none), lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return kept.join(terms, "d", "left").select("doc_id", "text", "base", apart.alias("terms"))


def digest(found: DataFrame) -> DataFrame:
    line = F.transform("base", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    both = F.array_sort(
        F.concat(
            F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["n"].alias("n"), s["end"].alias("end"), s["kind"].alias("kind"))),
            F.transform("terms", lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS)).alias("n"), t["end"].alias("end"), F.when(t["disclosure"] >= REMOVE, GONE).otherwise(TERM).alias("kind"))),
        )
    )
    return found.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(line, ","), 256).alias("base_sha256"),
        F.array_join(F.transform(both, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",").alias("spans"),
    )


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", context: str = "line") -> DataFrame:
    """doc_id and the text with entities replaced by ``[KIND]``, strong terms removed and others made ``[TERM]``.

    Overlapping entities are replaced as one, under the first one's kind.
    """
    rows = _rows(docs, doc_id, text)
    found = find(docs, doc_id, text, context).where((F.size("base") > 0)).withColumn("h", F.xxhash64("doc_id", "text")).dropDuplicates(["h"])
    marks = F.array_sort(
        F.concat(
            F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("mark"))),
            F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["disclosure"] >= REMOVE, "").otherwise("[TERM]").alias("mark"))),
        )
    )
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    built = F.aggregate(
        marks,
        zero,
        lambda acc, m: F.struct(
            F.greatest(acc["at"], m["end"]).alias("at"),
            F.when(m["start"] >= acc["at"], F.array_append(F.array_append(acc["out"], F.col("text").substr((acc["at"] + 1).cast("int"), (m["start"] - acc["at"]).cast("int"))), m["mark"])).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.col("text").substr((acc["at"] + 1).cast("int"), F.length("text"))),
    )
    clean = found.select("h", built.alias("clean"))
    return rows.join(clean, "h", "left").select("doc_id", F.coalesce("clean", "text").alias("text"))
