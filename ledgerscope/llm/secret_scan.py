"""Secret scanning with a random forest that removes false positives.

Everything runs as DataFrame and SQL functions.  A wide pattern finds candidates and leaves the
choice to the forest: any value assigned to a name with a word of secrecy in it, of whatever
length and characters; the password of a login in an address; the body of a private key; runs of token characters
with a digit, dotted ones as one candidate, or of capitals.  Each gets its neighbourhood (text before and
after, the document's path) and features: length, changes between character
classes, letter pairs that the dictionary's words have too, shares of classes and
of different characters, how much of it dictionary words cover, an issuer's
format, words of secrecy, of example or of assignment nearby, a login, and signs of a
reference, an address or a test path.  A random forest fitted on labelled findings gives the
probability that a candidate is a secret; its trees become one SQL expression, so a
document is scanned and redacted within its own row: no shuffle, no key.

The forest is fitted on findings labelled by hand: ``FINDINGS_BY_HAND`` are written-out lines, each with its
secret or with none, whose slots are filled ``VARIANTS`` times (``shipped_findings``).  A label says what a line
was written to hold and owes nothing to the features.  Other labelled findings can be given;
``labelled_findings`` takes some from a corpus, by formats that speak for themselves
(``rule_label``).  Both labels weigh the same; the dictionary counts the words of all documents.

Defined results: null text has no candidates and stays null; empty text stays
empty; a null path is no sign; repeated rows give equal results; with given
findings of one kind only, or none, candidates that the rules call secrets have
probability 1 and others 0; an empty table gives an empty result; other columns
pass through, except ones named like a result column.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm.common import durable

FINDINGS = 20_000
DICTIONARY_WORDS = 300
TREES, DEPTH, SEED = 20, 7, 7
THRESHOLD = 0.5
NEAR = 48
MASK = "[SECRET]"

_RUN = r"[A-Za-z0-9+/_\-]"
_NAME = r"[A-Za-z0-9_.\-]"
_SAYS_SECRET = (r"(?i:pass|pwd|secret|token|credential|bearer|auth|(?:api|access|private|encryption|signing|account)[_\-. ]?key)")
_SETS = r"""["']?[ \t]{0,3}[:=]{1,2}>?[ \t]{0,3}"""
#: A name that says so, an assignment and its value: in quotes whatever they hold, else up to a blank.
_ASSIGNED_VALUE = (rf"""((?<!{_NAME}){_NAME}++{_SETS}(?<={_SAYS_SECRET}{_NAME}{{0,16}}{_SETS})(?:(?i:bearer|basic)[ ]{{1,3}})?["']?)"""
                   r"""(?:(?<=")([^"\n]++)(?=")|(?<=')([^'\n]++)(?=')|(?<!["'])([^\s"',;<>`]*[^\s"',;<>`.!?:()\[\]{}]))""")
_LOGIN = r"(://[^\s:/@]{0,64}:)([^\s/@]++)(?=@)"
_PRIVATE_KEY = r"(-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----)([^\-]++)(?=-----END)"
#: Token characters with a digit, 12 at least, or 20 in parts with dots between; or 16 capitals.
_TOKEN = (rf"((?<![A-Za-z0-9+/_@.\-])(?:(?=[0-9+/_.\-]*+[A-Za-z])(?=[A-Za-z+/_.\-]*+[0-9])(?=[A-Za-z0-9+/_.\-]{{20}}){_RUN}++(?:\.{_RUN}++)++={{0,2}}"
          rf"|(?=[A-Za-z+/_\-]*+[0-9]){_RUN}{{12,}}={{0,2}}|[A-Z]{{16,}}(?!{_RUN})))")
CANDIDATE = f"{_ASSIGNED_VALUE}|{_LOGIN}|{_PRIVATE_KEY}|{_TOKEN}"
#: What precedes a candidate in its match, and the candidate: only one alternative's groups are set.
_BEFORE, _ITSELF = "$1$5$7", "$2$3$4$6$8$9"
_OPEN, _CLOSE = "\x01", "\x02"  # marks around candidates; taken out of the text first

_LAST = r"\w*\W+(\w+\W+){0,2}$"  # as one of the last three words before the candidate
SECRECY = f"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api.?key|access.?key|private.?key|credential|auth|bearer){_LAST}"
EXAMPLE = f"(?i)(example|sample|dummy|placeholder|commit|sha1|sha256|md5|checksum|digest|uuid){_LAST}"
SAYS_EXAMPLE = "(?i)example|sample|dummy|placeholder|changeme|xxxx"
ASSIGNED = r"(?i)[:=]>?\s*((bearer|basic)\s+)?[\"']?$"
LOGIN = r"://[^\s:/@]*:$"
#: A name or a call that stands for a value, or a word that says there is none.
REFERS = (r"(?i)^[$%&@<{(\[]|[({\[]|^(none|null|nil|true|false|undefined|empty|required|optional|str|string|int|text|bytes|bool|object|type|"
          r"hidden|redacted|removed|masked|n/?a|your|os|self|this|env|config|settings)([^A-Za-z0-9].*)?$|^[*xX.\-]+$")
TEST_PATH = r"(?i)(^|[/_.\-])(tests?|examples?|samples?|docs?|fixtures?|mocks?|vendor)([/_.\-]|$)"
ISSUED = "^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[0-9A-Za-z]{36,}$|^xox[abprs]-|^sk_live_|^AIza[0-9A-Za-z_\\-]{35}$"

FEATURES = ["length", "changes", "pairs", "digits", "uppers", "hexes", "distinct", "covered", "issued", "secrecy",
            "example", "assigned", "quoted", "address", "test_path", "login", "refers", "symbols", "parts"]
#: Letter pairs of the dictionary that count as common.
PAIRS = 150


def candidates(text: Column) -> Column:
    """``array<struct<candidate, before, after>>`` in order of occurrence."""
    return _neighbours(marked(text))


def marked(text: Column) -> Column:
    """The text's pieces; all but the first begin with a candidate and its closing mark."""
    return F.split(F.regexp_replace(F.translate(text, _OPEN + _CLOSE, ""), CANDIDATE,
                                    f"{_BEFORE}{_OPEN}{_ITSELF}{_CLOSE}"), _OPEN)


def _neighbours(parts: Column) -> Column:
    # Piece 0 precedes the first candidate; a later piece is a candidate, the closing mark and what follows.
    open_parts = F.transform(parts, lambda p: F.struct(
        F.substring_index(p, _CLOSE, 1).alias("candidate"),
        F.right(F.substring_index(p, _CLOSE, -1), F.lit(NEAR)).alias("tail"),
        F.left(F.substring_index(p, _CLOSE, -1), F.lit(NEAR)).alias("after")))
    own = F.slice(open_parts, F.lit(2), F.greatest(F.size(open_parts) - 1, F.lit(0)))
    return F.coalesce(F.zip_with(own, open_parts, lambda x, last: F.when(x.isNotNull(), F.struct(
        x["candidate"].alias("candidate"), last["tail"].alias("before"), x["after"].alias("after")))),
        F.array().cast("array<struct<candidate:string,before:string,after:string>>"))


def found(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_parts``, the text cut at its candidates, and ``_found``, the candidates."""
    return docs.withColumn("_parts", marked(F.col(text))).withColumn(
        "_found", F.filter(_neighbours(F.col("_parts")), lambda x: x.isNotNull()))


def features(x: Column, path: Column, words: list[str]) -> dict[str, Column]:
    c, before, after = x["candidate"], x["before"], x["after"]
    n = F.length(c).cast("double")
    flag = lambda test: F.coalesce(test, F.lit(False)).cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    rest = F.regexp_replace(F.lower(c), f"({'|'.join(words)})", "") if words else c
    counted = Counter(w[i:i + 2] for w in words for i in range(len(w) - 1))
    common = sorted(sorted(counted), key=lambda pair: -counted[pair])[:PAIRS]
    return {
        "length": n,
        "changes": F.regexp_count(c, F.lit("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])"
                                           "|(?<=[A-Z])(?=[a-z])")) / n,
        "pairs": F.regexp_count(F.lower(c), F.lit(f"(?={'|'.join(common)})")) / n if common else F.lit(0.0),
        "digits": share("[0-9]"), "uppers": share("[A-Z]"), "hexes": share("[0-9a-f]"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "covered": 1 - F.length(rest) / n,
        "issued": flag(c.rlike(ISSUED)), "secrecy": flag(before.rlike(SECRECY)), "example": flag(before.rlike(EXAMPLE) | c.rlike(SAYS_EXAMPLE)),
        "assigned": flag(before.rlike(ASSIGNED)), "quoted": flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
        "address": flag((before.rlike(r"(://\S*|[/@])$") | after.rlike("^(@|[.][A-Za-z]|/)") | c.rlike("^//|://"))
                        & ~before.rlike(LOGIN)),
        "test_path": flag(path.rlike(TEST_PATH)), "login": flag(before.rlike(LOGIN) & after.rlike("^@")),
        "refers": flag(c.rlike(REFERS)), "symbols": share(r"[^A-Za-z0-9+/_.\-]"), "parts": share("[./]"),
    }


def rule_label(f: dict[str, Column]) -> Column:
    """1 or 0 where the format or the neighbourhood settles it, else null."""
    return (F.when((f["example"] > 0) | (f["test_path"] > 0) | (f["refers"] > 0), 0.0)
            .when((f["issued"] > 0) | (f["login"] > 0) | ((f["secrecy"] > 0) & (f["assigned"] > 0) & (f["covered"] < 0.5)), 1.0)
            .when((f["digits"] >= 0.999) | (f["address"] > 0) | (f["covered"] >= 0.6), 0.0)
            .when((f["secrecy"] == 0) & (f["changes"] < 0.15), 0.0))


def dictionary(docs: DataFrame, text: str = "text") -> list[str]:
    """The most frequent words of four letters or more in all documents, counted in each task first."""
    each = docs.select(
        F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0))).alias("word"))
    rows = each.groupBy("word").count().orderBy(F.desc("count"), "word").limit(DICTIONARY_WORDS).collect()
    return sorted((r["word"] for r in rows), key=lambda w: (-len(w), w))


def labelled_findings(docs: DataFrame, words: list[str], text: str = "text", path: str | None = "source",
                      most: int = FINDINGS) -> DataFrame:
    """Features and ``label`` of different findings that the rules label, of each label at most about
    half of ``most``, drawn by a hash."""
    where = F.col(path) if path else F.lit(None).cast("string")
    each = found(docs, text).select(where.alias("path"), F.explode("_found").alias("x"))
    f = features(F.col("x"), F.col("path"), words)
    rows = each.select(*[c.alias(n) for n, c in f.items()], rule_label(f).alias("label"),
                       F.xxhash64("x").alias("h")).where("label IS NOT NULL")
    rows = durable(rows.dropDuplicates(["h", "label", "test_path"]), "findings")
    rate = F.lit(1.0)
    for r in rows.groupBy("label").count().collect():
        rate = F.when(F.col("label") == r["label"], min(1.0, most / 2 / r["count"])).otherwise(rate)
    return rows.where(F.pmod("h", F.lit(1 << 40)) < rate * (1 << 40)).drop("h")


#: Findings by hand: what precedes, the secret (None: the line holds none), what follows, the path.  Slots in braces are filled
#: anew for each variant (``_SLOTS``).
FINDINGS_BY_HAND = [
    ("{word} password = \"", "{word}{d2}!{word}#{d1}", "\" {word}", "src/{word}.py"),
    ("{word} password: ", "{word}{word}{word}", " {word} {word}", "{word}.yml"),
    ("password=", "{s9}", " {word}", "{word}.env"),
    ("password: ", "{word}{word}{word}{word}", "", ""),
    ("{word} password: ", "{word}{word}", "\n{word}", "{word}"),
    ("password=", "{word}{word}{d1}", "", "{word}"),
    ("secret = ", "{word}-{word}-{word}", "", "{word}"),
    ("password: ", "{s6}", "", ""),
    ("password = \"", "{word}{sym}", "\"", "{word}"),
    ("{word} password=", "{hex20}", " {word} {word}", "{word}"),
    ("DB_PASSWORD='", "{word}{sym}{d4}", "'", "deploy/{word}.sh"),
    ("passwd: ", "{Word}{sym}{d4}", "\n{word}", "{word}"),
    ("the pwd = ", "{s6}{sym}{d2}", ", {word}", "{word}.txt"),
    ("{word} passphrase: \"", "{word} {word} {word} {d2}", "\"", "{word}.md"),
    ("token: '", "{word} {word} {d1} {word}", "'", ""),
    ("secret = \"", "{word} {word} {word}", "\"", "{word}"),
    ("{word} token = \"", "{hex40}", "\" {word} {word}", "{word}"),
    ("{word} {word}. token = \"", "{hex40}", "\"", "{word}"),
    ("token: ", "{mix24}", " {word}", "{word}.json"),
    ("\"auth_token\": \"", "{mix36}", "\",", "{word}.json"),
    ("api_key: ", "{hex32}", " {word}", "{word}.ini"),
    ("API-KEY=", "{mix24}", "\n", "{word}"),
    ("client_secret = '", "{b64}", "';", "{word}.rb"),
    ("{word} secret: ", "{mix16}", " {word}", "{word}"),
    ("aws_access_key_id = ", "AKIA{caps16}", "\n{word}", "{word}.cfg"),
    ("{word} {word} ", "AKIA{caps16}", " {word} {word}", "{word}"),
    ("{word} {word} ", "ghp_{mix36}", " {word}", "{word}"),
    ("key ", "sk_live_{mix24}", " {word}", "{word}.js"),
    ("{word} ", "AIza{mix35}", " {word}", "{word}.html"),
    ("hook xoxb-", None, " {word}", "{word}"),
    ("{word} ", "xoxb-{num12}-{num12}-{mix24}", "", "{word}.py"),
    ("Authorization: Bearer ", "eyJ{mix16}.eyJ{mix36}.{mix36}", "\n", "{word}"),
    ("{word} ", "eyJ{mix24}.eyJ{mix36}{mix24}.{mix36}", " {word}", "{word}"),
    ("SENDGRID ", "SG.{mix16}.{mix36}", " {word}", "{word}.env"),
    ("key: ", "SG.{mix24}.{mix36}", " {word}", "{word}"),
    ("postgres://{word}:", "{word}{d4}", "@{word}.example.com/{word}", "{word}.yml"),
    ("{word} mysql://root:", "{s9}", "@10.0.{d2}.{d2}:3306/{word}", "{word}"),
    ("https://{word}:", "{mix24}", "@{word}.org/{word}.git", "{word}.sh"),
    ("-----BEGIN PRIVATE KEY-----", "\n{b64}", "-----END PRIVATE KEY-----", ""),
    ("{word} -----BEGIN EC PRIVATE KEY-----", "\n{mix24}\n", "-----END EC PRIVATE KEY----- {word}", "{word}"),
    ("-----BEGIN RSA PRIVATE KEY-----", "\n{b64}\n{b64}\n", "-----END RSA PRIVATE KEY-----", "{word}.pem"),
    ("private_key = \"", "{b64}", "\"", "{word}.py"),
    ("{word} commit {hex40} {word}", None, " {word}", "{word}"),
    ("{word} commit {hex39}1 {word}", None, "", "{word}"),
    ("sha256 {hex64} {word}", None, "", "{word}.lock"),
    ("sha256 {hex63}2", None, "", "{word}"),
    ("checksum: {hex32} {word}", None, "", "{word}"),
    ("uuid {uuid} {word}", None, "", "{word}.log"),
    ("{word} id {uuid} {word}", None, "", "{word}"),
    ("{word} {num16} {word} {num16}", None, " {word} {num12}", "{word}"),
    ("{word} +1 {num12} {word} {num16}{d2}", None, "", "{word}"),
    ("{word} 20{d2}-{d2}-{d2}T{d2}-{d2} {word}", None, "", "{word}.csv"),
    ("https://x.org/page-{d2}/item{d4}list {word}", None, "", "{word}"),
    ("https://{word}.example.com/{word}/{d4}/{word}.html {word}", None, "", "{word}.md"),
    ("//mail{d1}.example.com/{word}/{word}{d2} {word}", None, "", "{word}"),
    ("{word}.{d2}@mail{d1}.example.com {word}", None, "", "{word}"),
    ("{word}_{word}_{d1} {word}_{word}_{word}_{d2} {word}", None, "", "{word}.py"),
    ("{word}-{word}-{word}{d2} {word}/{word}/{word}{d2}", None, " {word}", "{word}"),
    ("{word}{word}{d2}{word} {word}", None, "", "{word}"),
    ("{Word}{Word}Of{Word}{d1}() {word}", None, "", "{word}.java"),
    ("lib/{word}/{word}{d2}.{word}.so.{d1} {word}", None, "", "{word}"),
    ("import {word}.{word}.{word}{d1}.{word}{word}", None, "", "{word}.java"),
    ("{word}-{d1}.{d2}.{d1}.tar.gz.{word}", None, "", "{word}"),
    ("ABSTRACTFACTORYMANAGER {word} CONFIGURATIONSERVICES", None, "", "{word}"),
    ("password = os.environ[\"{word}\"]", None, " {word}", "{word}.py"),
    ("password: str, token: Optional", None, "", "{word}.py"),
    ("token = get_{word}(x)", None, " {word}", "{word}.js"),
    ("password=${DB_{word}} ", None, "", "{word}.yml"),
    ("password: <{word}> token: null", None, "", "{word}.md"),
    ("secret: none {word} password: required", None, "", "{word}"),
    ("password: ******** {word}", None, "", "{word}"),
    ("{word} password = \"example{d2}\" {word}", None, "", "docs/{word}.md"),
    ("token = \"xxxxxxxxxxxx{d2}\"", None, "", "{word}"),
    ("token: \"{hex40}\"", None, " {word}", "tests/{word}.py"),
    ("password = \"{s9}\"", None, "", "examples/{word}.py"),
    ("api_key = \"sample{mix24}\"", None, "", "{word}"),
    ("dummy token = {hex32}", None, "", "{word}"),
    ("author: {word} {word}", None, "", "{word}"),
    ("bypass: true, compass: {word}", None, "", "{word}"),
]
VARIANTS = 60
#: Words for slots where the corpus has no dictionary.
_PLAIN_WORDS = ["house", "river", "table", "garden", "number", "simple", "market", "winter", "letter", "button"]


def _slots(words: list[str]) -> dict[str, Callable[[Column], Column]]:
    """Slot -> what fills it, from a seed that no other slot has."""
    def digest(seed: Column) -> Column:
        return F.sha2(seed, 256)

    def mixed(n: int) -> Callable[[Column], Column]:
        return lambda seed: F.left(F.translate(F.base64(F.unhex(digest(seed))), "+/=", "xyz"), F.lit(n))

    def number(n: int) -> Callable[[Column], Column]:
        return lambda seed: F.left(F.translate(digest(seed), "abcdef", "123456"), F.lit(n))

    def hexed(n: int) -> Callable[[Column], Column]:
        return lambda seed: F.left(digest(seed), F.lit(n))

    def word(seed: Column) -> Column:
        listed = F.array(*[F.lit(w) for w in (sorted(words) or _PLAIN_WORDS)])
        return F.element_at(listed, (F.pmod(F.xxhash64(seed), F.size(listed)) + 1).cast("int"))

    low = lambda n: lambda seed: F.concat(F.left(F.translate(digest(seed), "012345678", "ghkmprstw"), F.lit(n - 2)),
                                          F.left(F.translate(F.reverse(digest(seed)), "abcdef", "345678"), F.lit(2)))
    found = {f"{{hex{n}}}": hexed(n) for n in (20, 32, 39, 40, 63, 64)}
    found |= {f"{{mix{n}}}": mixed(n) for n in (16, 24, 35, 36)}
    found |= {f"{{num{n}}}": number(n) for n in (12, 16)} | {f"{{d{n}}}": number(n) for n in (1, 2, 4)}
    found |= {"{s6}": low(6), "{s9}": low(9),
              "{b64}": lambda seed: F.base64(F.unhex(F.concat(digest(seed), F.left(digest(F.reverse(seed)), F.lit(32))))),
              "{caps16}": lambda seed: F.upper(F.left(F.translate(digest(seed), "0189", "QRST"), F.lit(16))),
              "{uuid}": lambda seed: F.regexp_replace(F.left(digest(seed), F.lit(32)), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"),
              "{sym}": lambda seed: F.substring(F.lit("!#$%&*+?@"), F.pmod(F.xxhash64(seed), F.lit(9)).cast("int") + 1, F.lit(1)),
              "{Word}": lambda seed: F.initcap(word(seed)), "{word}": word}
    return found


def _filled(template: Column, seed: Column, words: list[str]) -> Column:
    """``template`` cut at its slots, each piece followed by its slot's filling."""
    slots = _slots(words)
    pieces = F.regexp_extract_all(template, F.lit(r"\{[A-Za-z0-9]+\}|\{|[^{]+"), F.lit(0))

    def fill(piece: Column, i: Column) -> Column:
        own = F.concat(seed, F.lit(":"), template, F.lit(":"), i.cast("string"))
        out = piece
        for name, made in slots.items():
            out = F.when(piece == name, made(own)).otherwise(out)
        return out

    return F.coalesce(F.array_join(F.transform(pieces, fill), ""), F.lit(""))


def shipped_findings(spark: SparkSession, words: list[str], variants: int = VARIANTS) -> DataFrame:
    """Features and ``label`` of the candidates in ``FINDINGS_BY_HAND``; 1 for a line's own secret."""
    names = ("line", "before", "secret", "after", "path")
    by_hand = F.array(*[F.struct(*[F.lit(v).cast("int" if n == "line" else "string").alias(n) for n, v in zip(names, (i, *line))])
                        for i, line in enumerate(FINDINGS_BY_HAND)])
    lines = spark.range(1).select(F.inline(by_hand))
    each = lines.select("*", F.explode(F.sequence(F.lit(1), F.lit(variants))).alias("variant"))
    seed = F.concat_ws("-", "line", "variant")
    each = each.select(*[_filled(F.col(c), F.concat(seed, F.lit(c)), words).alias(c) for c in ("before", "after", "path")],
                       F.when(F.col("secret").isNotNull(), _filled(F.col("secret"), seed, words)).alias("secret"))
    made = durable(each, "findings-by-hand").withColumn("text", F.concat("before", F.coalesce("secret", F.lit("")), "after"))
    rows = found(made).select("path", "secret", F.explode("_found").alias("x"))
    f = features(F.col("x"), F.col("path"), words)
    label = F.coalesce(F.col("x.candidate") == F.col("secret"), F.lit(False)).cast("double")
    return durable(rows.select(*[c.alias(n) for n, c in f.items()], label.alias("label")), "findings")


def _tree(node) -> str:
    if node.subtreeDepth() == 0:
        stats = list(node.impurityStats().stats())
        return repr(stats[1] / max(sum(stats), 1e-12)) if len(stats) > 1 else "0.0"
    split = node.split()
    return (f"IF(x.{FEATURES[split.featureIndex()]} <= {split.threshold()!r}D, "
            f"{_tree(node.leftChild())}, {_tree(node.rightChild())})")


def fit_forest(findings: DataFrame) -> str | None:
    """The forest as a SQL expression over a struct ``x`` of features; None if a class is missing.

    Both classes weigh the same, so how rare one is decides nothing.
    """
    kinds = {r["label"]: r["count"] for r in findings.groupBy("label").count().collect()}
    if not {0.0, 1.0} <= kinds.keys():
        return None
    weight = F.when(F.col("label") == 1, max(1.0, kinds[0.0] / kinds[1.0])).otherwise(
        max(1.0, kinds[1.0] / kinds[0.0]))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="f").transform(findings).select(
        "f", "label", weight.alias("weight"))
    model = RandomForestClassifier(featuresCol="f", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH,
                                   featureSubsetStrategy="sqrt", seed=SEED).fit(rows)
    trees = [_tree(t._call_java("rootNode")) for t in model.trees]
    return f"({' + '.join(trees)}) / {len(trees)}.0D"


def scan(docs: DataFrame, words: list[str], forest: str | None, text: str = "text", path: str | None = "source",
         threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``n_candidates``, ``secrets`` (candidate, before, probability) and ``redacted``."""
    where = F.col(path) if path else F.lit(None).cast("string")

    def scored(x: Column) -> Column:
        f = features(x, where, words)
        made = [c.alias(n) for n, c in f.items()]
        rule = F.coalesce(rule_label(f), F.lit(0.0)).alias("rule")
        return F.struct(x["candidate"].alias("candidate"), x["before"].alias("before"), rule, *made)

    result = ["n_candidates", "secrets", "redacted"]
    rows = found(docs.drop(*result), text).withColumn("_scored", F.transform("_found", scored))
    p = f"transform(_scored, x -> {forest or 'x.rule'})"
    rows = rows.withColumn("_p", F.expr(p)).withColumn("_secret", F.transform("_p", lambda v: v >= threshold))
    listed = F.zip_with("_scored", "_p", lambda x, v: F.struct(
        x["candidate"].alias("candidate"), x["before"].alias("before"), v.alias("probability")))
    # A piece that begins with a secret gets the mask instead.
    parts = F.col("_parts")
    own = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    masked = F.concat(F.element_at(parts, 1), F.array_join(F.zip_with(
        own, F.col("_secret"), lambda piece, secret: F.concat(
            F.when(secret, F.lit(MASK)).otherwise(F.substring_index(piece, _CLOSE, 1)),
            F.substring_index(piece, _CLOSE, -1))), ""))
    any_secret = F.exists("_secret", lambda s: s)
    return (rows.withColumn("n_candidates", F.size("_found").cast("long"))
            .withColumn("secrets", F.filter(listed, lambda x: x["probability"] >= threshold))
            .withColumn("redacted", F.when(any_secret, masked).otherwise(F.col(text)))
            .drop("_parts", "_found", "_scored", "_p", "_secret"))


def scan_secrets(docs: DataFrame, text: str = "text", path: str | None = "source",
                 findings: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Fit on ``findings`` (``FEATURES`` and ``label``), or on those labelled by hand, and scan ``docs``."""
    words = dictionary(docs, text)
    forest = fit_forest(findings if findings is not None else shipped_findings(docs.sparkSession, words))
    return scan(docs, words, forest, text, path, threshold)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = scan_secrets(docs)
    return out.select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), "secrets",
                      F.sha2("redacted", 256).alias("redacted_sha256"))
