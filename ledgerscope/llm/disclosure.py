"""Personal data, and the terms that give it away: information-theoretic sanitisation.

Everything runs as DataFrame and SQL functions.  Patterns find the protected entities (e-mail and IP
addresses, card and phone numbers).  Removing those alone leaves words that stand near an
entity wherever it occurs and hardly anywhere else, such as a name beside an address.  How strongly a term reveals an entity is
estimated from the corpus:

    disclosure(term, entity) = 1 - ln p(entity | term) / ln p(entity)

the part of the entity's information (-ln p(entity)) that the term gives away.  p(entity)
is the share of documents that mention it; p(entity | term) of the documents with the term, the share in which the term
stands within ``NEAR_WORDS`` words of it.  A term whose disclosure reaches ``DISCLOSURE`` is sanitised wherever it occurs in
the documents where it stands near the entity.  It is generalised to its first half where
the class of all words with that half discloses less than the threshold, else removed.  A pair counts once
``SUPPORT`` different texts hold it: a single text can't tell a link from chance.

Pairs come from windows, so they grow with the mentions, never with their square; counts are map-side
combined, by text first, so copies of a text are one row a task.  Terms reach the documents by
a join on the text's digest.

Offsets are code points from 0, end exclusive.  Patterns are written so that they need no
backtracking over long runs; they find what the plain ones find.

Defined results: null text is empty text and has no spans; entities equal but for letter case (e-mail) or
separators (card, phone) are one; an entity in every document has no information to
reveal; terms are words of ``LETTERS`` letters or more, lower-cased A-Z; a term's place inside a base span is left
to that span; repeated rows get equal results; an empty table gives an empty result; other columns pass
through, except ones named like a result column, which the result replaces.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm.common import durable, table

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: The kinds' patterns.  An e-mail begins where its run of characters does, or where the last one ended;
#: a card's digits are a whole run of 14 to 19.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+\-]))[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ \-])[0-9](?:[ \-]?[0-9]){13,18}+(?![ \-]?[0-9])",
    "phone": r"\+[0-9][ ().0-9\-]+[0-9]",
}
#: What a text must hold for its kind to be looked for.
_NEEDS = {"email": "[@]", "ip": "[0-9][.][0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
_ADDRESS = rf"^{_PART}(?:\.{_PART}){{3}}$"

DISCLOSURE = 0.8
SUPPORT = 3
NEAR_WORDS = 5
#: Code points of text read on each side of a mention for its words.
NEAR_CHARS = 160
LETTERS = 3
_LETTER = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]"
_WORD = f"{_LETTER}{{{LETTERS},}}"
_BLOCK = 256

SPAN = "struct<start:int,order:int,end:int,kind:string,value:string>"


def lowered(text: Column) -> Column:
    """``text`` with A-Z lower-cased; no code point moves."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """``merge`` of every prefix of an array of ints (0 to begin with), in blocks: appending to one
    array would copy it for every element."""
    def prefixes(part: Column) -> Column:
        return F.aggregate(part, F.array().cast("array<int>"), lambda done, x: F.concat(done, F.array(
            merge(F.coalesce(F.get(done, F.size(done) - 1), F.lit(0)), x))))

    starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int"))
    blocks = F.transform(starts, lambda b: prefixes(F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK))))
    joined = _bound(blocks, lambda made: _bound(
        prefixes(F.transform(made, lambda b: F.element_at(b, -1))),
        lambda last: F.flatten(F.transform(made, lambda b, i: F.transform(
            b, lambda x: merge(F.coalesce(F.get(last, i - 1), F.lit(0)), x))))))
    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(joined)


def _cut(text: Column, pattern: Column) -> tuple[Column, Column]:
    """The matches of ``pattern`` and the text around them, one piece more."""
    return F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern)


def _located(matches: Column, gaps: Column, kind: str, order: int, keep: Callable[[Column], Column]) -> Column:
    ends = running(F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)),
                              lambda m, g: F.length(g) + F.length(m)), lambda a, b: a + b)
    made = F.zip_with(matches, ends, lambda m, end: F.struct(
        (end - F.length(m)).alias("start"), F.lit(order).alias("order"), end.alias("end"),
        F.lit(kind).alias("kind"), m.alias("value")))
    return F.filter(made, lambda x: keep(x["value"]))


def located(text: Column, pattern: Column, kind: str, order: int,
            keep: Callable[[Column], Column] = lambda m: F.lit(True)) -> Column:
    """``array<SPAN>``: the places of ``pattern`` in ``text``, in order, of the matches that ``keep`` accepts."""
    found = _bound(F.regexp_extract_all(text, pattern, F.lit(0)), lambda matches: F.when(
        F.exists(matches, keep), _located(matches, F.split(text, pattern), kind, order, keep)))
    return F.coalesce(found, F.array().cast(f"array<{SPAN}>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    doubled = F.transform(F.reverse(F.regexp_extract_all(digits, F.lit("[0-9]"), F.lit(0))), lambda d, i: F.when(
        i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


ACCEPTS: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(_ADDRESS),
    "card": lambda m: passes_luhn(_digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
}


def entity(kind: str, value: Column) -> Column:
    """One spelling of an entity's value; no blanks."""
    plain = lowered(value) if kind == "email" else value if kind == "ip" else _digits(value)
    return F.concat(F.lit(f"{kind}:"), plain)


def base_spans(text: Column) -> dict[str, Column]:
    """Each kind's spans in ``text`` (not null)."""
    none = F.array().cast(f"array<{SPAN}>")
    return {k: F.when(text.rlike(_NEEDS[k]), located(text, F.lit(PATTERNS[k]), k, i, ACCEPTS[k])).otherwise(none)
            for i, k in enumerate(KINDS)}


def _near(before: Column, after: Column) -> Column:
    """The words on either side of a mention, without other entities' parts and words cut in two."""
    others = "|".join(PATTERNS[k] for k in KINDS)
    head = F.when(F.length(before) > NEAR_CHARS, F.regexp_replace(
        F.right(before, F.lit(NEAR_CHARS)), f"^{_LETTER}+", "")).otherwise(before)
    tail = F.when(F.length(after) > NEAR_CHARS, F.regexp_replace(
        F.left(after, F.lit(NEAR_CHARS)), f"{_LETTER}+$", "")).otherwise(after)

    def words(part: Column) -> Column:
        return F.regexp_extract_all(lowered(F.regexp_replace(part, others, " ")), F.lit(_WORD), F.lit(0))

    return F.concat(F.slice(F.reverse(words(head)), 1, NEAR_WORDS), F.slice(words(tail), 1, NEAR_WORDS))


def mentions(text: Column, kind: str) -> Column:
    """``array<string>``: ``entity`` and a blank for each mention, and with a word of its window after the blank."""
    accept = ACCEPTS[kind]
    none = F.array().cast("array<string>")

    def pairs(matches: Column) -> Column:
        own = F.transform(matches, lambda m, i: F.when(accept(m), F.struct(entity(kind, m).alias("e"), i.alias("i"))))
        return _bound(F.split(text, F.lit(PATTERNS[kind])), lambda gaps: F.flatten(F.transform(
            F.filter(own, lambda x: x.isNotNull()), lambda x: F.transform(
                F.concat(F.array(F.lit("")), _near(F.get(gaps, x["i"]), F.get(gaps, x["i"] + 1))),
                lambda word: F.concat(x["e"], F.lit(" "), word)))))

    found = _bound(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)),
                   lambda matches: F.when(F.exists(matches, accept), pairs(matches)))
    return F.when(text.rlike(_NEEDS[kind]), F.coalesce(found, none)).otherwise(none)


def contexts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``digest, entity, term, rows``: for each different text its entities (``term`` empty) and the words near them."""
    whole = F.coalesce(F.col(text), F.lit(""))
    each = docs.select(whole.alias("text")).select(
        F.md5("text").alias("digest"),
        F.array_distinct(F.concat(*[mentions(F.col("text"), k) for k in KINDS])).alias("pairs"))
    return (each.select("digest", F.explode("pairs").alias("pair")).groupBy("digest", "pair").agg(F.count("*").alias("rows"))
            .select("digest", F.substring_index("pair", " ", 1).alias("entity"),
                    F.substring_index("pair", " ", -1).alias("term"), "rows"))


def general_form(term: Column) -> Column:
    return F.concat(F.left(term, F.ceil(F.length(term) / 2).cast("int")), F.lit("*"))


def disclosure(together: Column, term_rows: Column, entity_rows: Column, rows: int) -> Column:
    """Part of the entity's information that the term gives away; 0 where there is none to give."""
    given = F.log(together.cast("double") / term_rows) / F.log(entity_rows.cast("double") / F.lit(float(rows)))
    return F.when(entity_rows < rows, 1 - given).otherwise(F.lit(0.0))


def word_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """``term, term_rows``: documents that hold each word, counted in each task first."""
    words = F.array_distinct(F.regexp_extract_all(lowered(F.col(text)), F.lit(_WORD), F.lit(0)))
    return docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("term_rows"))


def revealing_terms(docs: DataFrame, held: DataFrame, text: str = "text", threshold: float = DISCLOSURE,
                    support: int = SUPPORT) -> DataFrame:
    """``entity, term, disclosure, replacement`` of the terms that reveal an entity.

    ``held`` is the corpus's ``contexts``; the replacement is empty where the term's general form reveals as much.
    """
    rows = docs.count()
    counts = held.groupBy("entity", "term").agg(F.sum("rows").alias("together"), F.count("*").alias("texts"))
    counts = durable(counts, "pairs").withColumn("form", general_form(F.col("term")))
    entities = counts.where("term = ''").select("entity", F.col("together").alias("entity_rows"))
    known = counts.where(f"term <> '' AND texts >= {support}")
    if known.isEmpty():  # no word to look up in the corpus
        return docs.sparkSession.createDataFrame([], "entity string, term string, disclosure double, replacement string")
    forms = durable(word_rows(docs, text).withColumn("form", general_form(F.col("term")))
                    .join(known.select("form").distinct(), "form", "left_semi"), "words")
    class_rows = forms.groupBy("form").agg(F.sum("term_rows").alias("form_rows"))
    class_near = counts.where("term <> ''").groupBy("entity", "form").agg(F.sum("together").alias("form_together"))
    scored = (known.join(forms.select("term", "term_rows"), "term").join(entities, "entity")
              .withColumn("disclosure", disclosure(F.col("together"), F.col("term_rows"), F.col("entity_rows"), rows))
              .where(F.col("disclosure") >= threshold)
              .join(class_near, ["entity", "form"]).join(class_rows, "form"))
    open_ = disclosure(F.col("form_together"), F.col("form_rows"), F.col("entity_rows"), rows) < threshold
    return scored.select("entity", "term", "disclosure",
                         F.when(open_, F.col("form")).otherwise(F.lit("")).alias("replacement"))


def _apart(spans: Column, base: Column) -> Column:
    return F.filter(spans, lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))


def _rewritten(text: Column, spans: Column, replacements: Column) -> Column:
    """``text`` with each span replaced; a span that begins inside an earlier one only lengthens the cut."""
    def built(reach: Column) -> Column:
        upto = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0))
        pieces = F.transform(spans, lambda x, i: F.when(x["start"] >= upto(i), F.concat(
            F.substring(text, upto(i) + 1, x["start"] - upto(i)),
            F.when(x["kind"] == TERM, F.coalesce(F.try_element_at(replacements, lowered(x["value"])), F.lit("")))
            .otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))))).otherwise(F.lit("")))
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(reach, -1) + 1, F.length(text)))

    ends = running(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
    return F.when(F.size(spans) == 0, text).otherwise(_bound(ends, built))


RESULT = ["n_email", "n_ip", "n_card", "n_phone", "base", "spans", "sanitised"]


def sanitise(docs: DataFrame, text: str = "text", threshold: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """``docs`` with ``n_<kind>``, ``base`` and ``spans`` (arrays of ``SPAN``) and ``sanitised``, the text without them."""
    held = durable(contexts(docs, text), "contexts")
    reveal = durable(revealing_terms(docs, held, text, threshold, support), "revealing")
    # A text's terms: at most the words of its own windows.
    per_text = durable(
        held.join(reveal, ["entity", "term"]).groupBy("digest", "term").agg(F.min("replacement").alias("replacement"))
        .groupBy("digest").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "replacement"))))
                               .alias("_terms")).withColumnRenamed("digest", "_digest"), "terms")
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.drop(*[c for c in RESULT if c != text]).withColumn("_digest", F.md5(whole))
    rows = rows.join(per_text, "_digest", "left").withColumn("_whole", whole)
    kinds = base_spans(F.col("_whole"))
    rows = rows.withColumns({f"_{k}": c for k, c in kinds.items()})
    rows = rows.withColumn("_base", F.array_sort(F.concat(*[F.col(f"_{k}") for k in KINDS])))
    pattern = F.concat(F.lit(f"(?<!{_LETTER})(?:"), F.array_join(F.map_keys("_terms"), "|"), F.lit(f")(?!{_LETTER})"))
    terms = F.when(F.col("_terms").isNull(), F.array().cast(f"array<{SPAN}>")).otherwise(
        _apart(located(lowered(F.col("_whole")), pattern, TERM, len(KINDS)), F.col("_base")))
    rows = rows.withColumn("_spans", F.array_sort(F.concat(F.col("_base"), terms)))
    out = {f"n_{k}": F.size(f"_{k}").cast("long") for k in KINDS}
    out |= {"base": F.col("_base"), "spans": F.col("_spans"),
            "sanitised": _rewritten(F.col("_whole"), F.col("_spans"), F.col("_terms"))}
    return rows.withColumns(out).drop("_digest", "_terms", "_whole", "_base", "_spans", *[f"_{k}" for k in KINDS])


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op12_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(written(F.col("base")), 256).alias("base_sha256"),
                      written(F.col("spans")).alias("spans"))
