"""Secret scans: candidates by one pattern, false positives removed by a random forest.

A candidate is a value of 6 or more characters, of any kind, behind a credential's name and = or :
(up to its closing quote, or to the next blank); the password of a URL's user:password@ part; or a
run of 12 or more characters of CANDIDATE that holds a digit, `=` or `:`. Text that
has candidates is split at them, which gives every candidate its neighbours. The forest sees length,
character transitions, dictionary coverage, signs of a path or address, and neighbouring words. It
is trained from labelled findings: rows of (kind, before, value, after, label). labelled_findings()
makes such rows from rules for common credential formats and for look-alikes (hashes, ids, paths,
addresses, numbers, placeholders); pass your own reviewed findings instead where you have them.

All of it is DataFrame operations. NULL and empty texts have no candidates. Equal rows give equal
findings; offsets count code points from 0. doc_id may be NULL.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CHARS = r"A-Za-z0-9_+/.~@:=-"
CANDIDATE = rf"(?<![{_CHARS}])(?=[A-Za-z_+/.~@-]*+[0-9:=])[{_CHARS}]{{12,}}+"
# The text in front of a value: a credential's name and = or :, and a URL's user (bounded, for Java's look-behind).
_LOOSE = r"passw(?:or)?d|passphrase|secret|credential|api[_-]?key|access[_-]?key|private[_-]?key"
_WHOLE = r"(?<![A-Za-z])(?:pwd|pass|token|auth|key|bearer)|(?<=[a-z])(?-i:Token|Key|Pwd|Pass)"
_NAME = rf"(?i:{_LOOSE}|{_WHOLE})s?[0-9]?(?:[_-][A-Za-z0-9]{{1,12}})?"
_SIGN = r"[\"']?\s{0,3}(?::=|=>|==|[:=])\s{0,3}"
_USER = r"://[^\s/:@\"']{0,64}:"
_BARE = r"[^\s\"'`]{5,255}[^\s\"'`,;.)\]}]"
# the cheapest tests come first: most places fail at the character in front
_NAMED = (
    rf"(?<=[:=>\s\"'])(?:"
    rf"(?<=\")(?<=[:=>]\s{{0,3}}\")(?<={_NAME}{_SIGN}\")[^\"\r\n]{{6,256}}(?=\")"
    rf"|(?<=')(?<=[:=>]\s{{0,3}}')(?<={_NAME}{_SIGN}')[^'\r\n]{{6,256}}(?=')"
    rf"|(?=[^\s\"'`=>:])(?<=[:=>]\s{{0,3}})(?<={_NAME}{_SIGN})(?!(?i:bearer|basic)\s){_BARE})"
)
_PASSWORD = r"[^\s/\"'<>]{3,128}(?=@)"
_IN_URL = rf"(?<=:)(?<={_USER}){_PASSWORD}"
_BEHIND_URL = rf"(?<=@)(?<={_USER}[^\s/\"'<>]{{3,128}}@)(?=[A-Za-z_+/.~@-]*+[0-9:=])[{_CHARS}]{{12,}}+"
# a run is left to the other forms where it holds one of their values
_OTHERS = rf"(?![A-Za-z0-9_+/.~@-]{{0,64}}(?=[\"'\s:=])(?<={_NAME}){_SIGN}{_BARE})(?![A-Za-z0-9_+.=-]{{1,64}}{_USER}{_PASSWORD})"
_RUN = rf"(?<![{_CHARS}])(?=[A-Za-z_+/.~@-]*+[0-9:=])(?=[{_CHARS}]{{12}}){_OTHERS}[{_CHARS}]{{12,}}+"
FOUND = rf"(?:{_NAMED}|{_IN_URL}|{_BEHIND_URL}|{_RUN})"
CONTEXT = 48
SHORT = 12  # values below this length are masked only where they were found
TREES = 20
DEPTH = 8
TRAINING_ROWS = 6000  # bound of the labelled findings that are made
THRESHOLD = 0.5
MASK = "[SECRET]"

# Words that credentials, and that look-alikes, are named with; dictionary words.
CREDENTIAL_WORDS = (
    "password passwd pwd pass secret token apikey api_key api-key access_key accesskey auth bearer "
    "credential credentials private_key client_secret key"
).split()
BENIGN_WORDS = (
    "commit sha sha1 sha256 md5 checksum digest hash uuid guid id version release build revision "
    "card phone tel mail email e-mail file path url see host ip isbn order"
).split()
DICTIONARY = (
    "example sample test dummy your here change changeme default placeholder insert redacted none "
    "null user name admin mail com org net http https www file path index image page data value "
    "number version release build config service server client local home usr var lib src main "
    "password secret token key the and for this that with from pour que die und der los las para"
).split()


def found_values(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({FOUND})"), 0)


def candidates(docs: DataFrame) -> DataFrame:
    """One row per candidate of (doc_id, text): doc_id, start, value, before, after. The parts
    between the candidates give the neighbours and the offsets."""
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    some = rows.filter(F.col("text").rlike(FOUND))
    cut = some.select("doc_id", found_values(F.col("text")).alias("values"), F.split("text", FOUND, -1).alias("parts"))
    left = F.transform("parts", lambda p: F.right(p, F.lit(CONTEXT)))
    right = F.transform("parts", lambda p: F.left(p, F.lit(CONTEXT)))
    # running length of all parts and values before each candidate
    own = F.zip_with("parts", "values", lambda p, v: F.struct(F.char_length(p).alias("p"), F.coalesce(F.char_length(v), F.lit(0)).alias("v")))
    sums = F.aggregate(
        own,
        F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<bigint>").alias("starts")),
        lambda s, x: F.struct(
            (s["end"] + x["p"] + x["v"]).alias("end"), F.concat(s["starts"], F.array(s["end"] + x["p"])).alias("starts")
        ),
    )["starts"]
    slim = cut.select("doc_id", "values", left.alias("l"), right.alias("r"), sums.alias("starts"))
    every = slim.select("doc_id", F.posexplode("values").alias("at", "value"), "l", "r", "starts")
    return every.select(
        "doc_id",
        F.get("starts", F.col("at")).alias("start"),
        "value",
        F.get("l", F.col("at")).alias("before"),
        F.get("r", F.col("at") + 1).alias("after"),
    )


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0)).cast("double")


def _kept(value: Column, chars: str) -> Column:
    return F.char_length(F.regexp_replace(value, f"[^{chars}]", "")).cast("double")


def _any_word(text: Column, words: list[str]) -> Column:
    return F.lower(text).rlike(r"(?<![a-z])(?:" + "|".join(words) + r")(?![a-z])").cast("double")


FEATURES = (
    "length digits upper lower symbols transitions distinct hex_only letters_only dictionary path "
    "address dotted quoted assigned named_credential named_benign near_credential near_benign prefix dashes "
    "behind_name behind_user blanks reference"
).split()


def core_of(value: Column) -> Column:
    """The value behind `name=` or `name:`, where there is one."""
    return F.regexp_replace(value, r"^[A-Za-z_.-]{2,40}[=:](?=[^/=:].{5,})", "")


def features(rows: DataFrame) -> DataFrame:
    """The rows with one column f_<name> per feature, from value, before and after."""
    value, before, after = F.col("value"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    core = core_of(value)
    name = F.regexp_extract(value, r"^([A-Za-z_.-]{2,40})[=:](?=[^/=:].{5,})", 1)
    n = F.char_length(core)
    runs = core
    for chars, sign in (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "9")):
        runs = F.regexp_replace(runs, chars, sign)
    covered = n - F.char_length(F.regexp_replace(F.lower(core), "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))
    # the name in front of `name = "value"`, and the word before that
    named = F.regexp_extract(before, r"([A-Za-z_-]+)[\"']?\s*[=:]\s*[\"']?$", 1)
    words = F.concat_ws(" ", F.regexp_extract(before, r"(\S+\s+\S+)\s*$", 1), F.regexp_extract(after, r"^\s*(\S+)", 1))
    made = {
        "length": n.cast("double"),
        "digits": _share(_kept(core, "0-9"), n),
        "upper": _share(_kept(core, "A-Z"), n),
        "lower": _share(_kept(core, "a-z"), n),
        "symbols": _share(_kept(core, "^A-Za-z0-9"), n),
        "transitions": _share(F.char_length(runs) - 1, n - 1),
        "distinct": _share(F.size(F.array_distinct(F.split(core, ""))), n),
        "hex_only": core.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "letters_only": core.rlike(r"^[A-Za-z]+$").cast("double"),
        "dictionary": _share(covered, n),
        "path": (value.rlike(r"(?:/[\w.-]+){2,}|\.[a-z]{2,4}$|://") | before.rlike(r"/$")).cast("double"),
        "address": value.contains("@").cast("double"),
        "dotted": core.rlike(r"^\d+(?:[.:-]\d+)+$").cast("double"),
        "quoted": before.rlike("[\"']$").cast("double"),
        "assigned": ((F.char_length(name) > 0) | (F.char_length(named) > 0)).cast("double"),
        "named_credential": _any_word(F.concat_ws(" ", name, named), CREDENTIAL_WORDS),
        "named_benign": _any_word(F.concat_ws(" ", name, named), BENIGN_WORDS),
        "near_credential": _any_word(words, CREDENTIAL_WORDS),
        "near_benign": _any_word(words, BENIGN_WORDS),
        "prefix": core.rlike(r"^(?:AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk[-_]|AIza|eyJ|glpat-|npm_)").cast("double"),
        "dashes": core.rlike(r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$").cast("double"),
        "behind_name": before.rlike(rf"(?:{_NAME}){_SIGN}[\"']?$").cast("double"),
        "behind_user": (before.rlike(rf"{_USER}$") & after.startswith("@")).cast("double"),
        "blanks": core.rlike(r"\s").cast("double"),
        # a variable, call, template or row of one sign in place of a value
        "reference": core.rlike(r"^(?:[$%]?[{<(\[]|\$[A-Z_]+$)|^(.)\1+$|\w\(|[\])}]$|^[A-Za-z_]+(?:\.[A-Za-z_]+)+$").cast("double"),
    }
    return rows.withColumns({f"f_{k}": F.coalesce(v, F.lit(0.0)) for k, v in made.items()})


def labelled_findings(spark: SparkSession, rows: int = TRAINING_ROWS) -> DataFrame:
    """Labelled findings by rule, the same for every call: kind, before, value, after, label."""

    def digest(salt: str) -> Column:
        return F.sha2(F.concat(F.lit(f"{salt} "), F.col("id").cast("string")), 256)

    def pick(salt: str, *values: str) -> Column:
        at = F.pmod(F.xxhash64(F.lit(salt), F.col("id")), F.lit(len(values))) + 1
        return F.element_at(F.array(*[F.lit(v) for v in values]), at.cast("int"))

    hexes = digest("hex")
    base = F.regexp_replace(F.base64(F.unhex(F.concat(digest("a"), digest("b")))), r"[\s+/=]", "")
    capital = F.upper(F.translate(F.substring(base, 1, 40), "abcdefghijklmnopqrstuvwxyz01", "ABCDEFGHIJKLMNOPQRSTUVWXYZ23"))
    digits = F.translate(digest("digits"), "abcdef", "012345")
    uuid = F.concat_ws("-", *[F.substring(hexes, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    word = pick("word", "river", "the order", "and then", "house of", "sobre la", "und der", "pour les", "on the thing")
    other = pick("other", "is", "was there", "und", "then.", "et la", "para los", "", "over the hill")
    name = pick("name", "password", "passwd", "pwd", "secret", "token", "api_key", "client_secret", "auth", "access_key")
    plain = pick("plain", "id", "file", "version", "order", "build", "ref", "page", "x", "commit")
    sign = pick("sign", "=", ": ", " = ", " = \"", "=\"", ":")
    quote = pick("quote", " = \"", "=\"", ": \"", " = '")
    size = pick("size", "16", "18", "20", "24", "32", "40").cast("int")
    end, text = F.concat(F.lit(" "), other), F.concat(word, F.lit(" "))

    tight = F.concat(text, name, pick("tight", "=", ":"))
    signs = pick("signs", "!", "&", "$", "@", "#", "%", "*", "?", "-", "")
    common = pick("common", "hunter", "dragon", "Summer", "Tr0ub4dor", "P@ssw0rd", "l3tmein", "Qwerty", "m0nkey", "Wint3r", "s3cr3t")
    short = F.concat(F.substring(base, 2, pick("n", "3", "4", "6").cast("int")), signs, F.substring(base, 12, pick("n2", "3", "5").cast("int")), pick("end", "!", "7", "#q", "$9"))
    worded = F.concat(common, signs, F.substring(digits, 1, pick("n3", "1", "2", "4").cast("int")))
    phrase = F.concat_ws("-", *[pick(f"phrase {k}", "correct", "horse", "battery", "staple", "purple", "garden", "window", "orbit") for k in range(4)])
    phrase = F.replace(phrase, F.lit("-"), pick("join", "-", "_", "."))
    any_form = F.concat(text, name, pick("any", "=", ":", ": ", " = ", " = \"", "=\"", "\": \"", " = '"))
    user = F.concat(text, pick("scheme", "postgres", "https", "mysql", "amqp", "redis", "ftp"), F.lit("://"), pick("user", "admin", "root", "app", "jo.smith", ""), F.lit(":"))
    host = F.concat(F.lit("@"), pick("host", "db.example.com/main", "10.0.0.5:5432/app", "localhost", "mail.org"), end)

    secret = [
        ("key id", text, F.concat(pick("aws", "AKIA", "ASIA"), F.substring(capital, 1, 16)), end),
        ("hex token", F.concat(text, name, quote), F.substring(hexes, 1, size), F.concat(F.lit('"'), end)),
        ("hex password", tight, F.substring(hexes, 1, size), end),
        ("mixed password", tight, F.substring(base, 3, size), end),
        ("mixed token", F.concat(text, name, sign), F.substring(base, 7, F.lit(32)), end),
        ("prefixed", text, F.concat(pick("pre", "ghp_", "gho_", "sk-", "xoxb-", "glpat-", "AIza", "npm_"), F.substring(base, 5, F.lit(36))), end),
        ("signed token", F.concat(text, F.lit("Bearer ")), F.concat(F.lit("eyJ"), F.substring(base, 1, 30), F.lit(".eyJ"), F.substring(base, 20, 40)), end),
        ("uuid key", F.concat(text, name, sign), uuid, end),
        ("short password", any_form, short, end),
        ("worded password", any_form, worded, end),
        ("phrase password", any_form, phrase, end),
        ("short in url", user, short, host),
        ("worded in url", user, worded, host),
    ]
    harmless = [
        ("hash", F.concat(text, pick("h", "commit ", "sha1 ", "md5 ", "checksum: ", "sha256: ", "revision ")), F.substring(hexes, 1, size), end),
        ("uuid", F.concat(text, pick("u", "id ", "uuid ", "see ", "")), uuid, end),
        ("number", text, F.substring(digits, 1, pick("d", "12", "13", "15", "16", "19").cast("int")), end),
        ("mail", text, F.concat(pick("m", "ann", "info", "jo.smith", "xkzo"), F.substring(digits, 1, 2), F.lit("@mail"), F.substring(digits, 5, 1), pick("dom", ".example.com", ".org", ".net")), end),
        ("address", text, F.concat_ws(".", *[F.concat(F.lit("1"), F.substring(digits, a, 2)) for a in (1, 4, 7, 10)]), end),
        ("path", F.concat(text, pick("p", "", "see ", "file ")), F.concat(pick("root", "https://www.", "/usr/lib/", "/home/", "src/"), pick("dir", "example.com/", "data/", "page/"), F.substring(hexes, 1, size), pick("ext", ".html", ".png", "/index", "")), end),
        ("word", text, F.concat(pick("w", "thingerheon", "RiverHouse", "main_config", "releaseNumber", "interestingly"), F.substring(digits, 1, 2)), end),
        ("setting", text, F.concat(plain, pick("s", "=", ":"), pick("v", "default12", "page2of10", "2024-01-15", "10:30:25", "localhost:8080")), end),
        ("placeholder", tight, F.concat(pick("ph", "your_password_1", "changeme123", "example1234", "<insert-here-1>", "xxxxxxxxxxxx1", "test12345678")), end),
        ("named word", text, F.concat(plain, F.lit("="), pick("nw", "interesting", "configuration", "documents")), end),
        ("prose", F.concat(text, name, F.lit(": ")), pick("prose", "please", "required", "forgotten", "should", "managers", "invalid", "expired", "protected", "anything", "authentication", "optional", "whatever"), end),
        ("said", any_form, pick("said", "is required here", "not given", "the one you know", "enter your own", "Please change it", "String", "string"), end),
        ("reference", any_form, pick("reference", "${DB_PASSWORD}", "$PASSWORD", "process.env.TOKEN", "os.getenv(TOKEN)", "getpass()", "self.password", "config.secret", "{{ secret }}", "<password>", "<your-token>", "********", "xxxxxxxx", "%(password)s"), end),
        ("default", any_form, pick("default", "changeme", "password", "example", "your_password", "default", "placeholder", "redacted", "[REDACTED]"), end),
        ("no password in url", user, pick("nourl", "password", "pass", "<password>", "${DB_PASS}", "********", "changeme", "secret", "example"), host),
    ]
    kinds = [(*k, 1.0) for k in secret] + [(*k, 0.0) for k in harmless]
    structs = [
        F.struct(F.lit(k).alias("kind"), b.alias("before"), v.alias("value"), a.alias("after"), F.lit(y).alias("label"))
        for k, b, v, a, y in kinds
    ]
    source = spark.range(0, rows, 1, 4)
    return source.select(F.element_at(F.array(*structs), (F.col("id") % len(structs) + 1).cast("int")).alias("f")).select("f.*")


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> PipelineModel:
    """The forest, from rows of before, value, after, label."""
    assembler = VectorAssembler(inputCols=[f"f_{x}" for x in FEATURES], outputCol="f_all")
    forest = RandomForestClassifier(featuresCol="f_all", labelCol="label", numTrees=trees, maxDepth=depth, seed=11)
    rows = assembler.transform(features(findings)).select("f_all", "label")
    model: RandomForestClassificationModel = forest.fit(rows)
    return PipelineModel(stages=[assembler, model])


def scored(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """The rows with score, the forest's share for a secret."""
    out = model.transform(features(rows)).withColumn("score", vector_to_array("probability")[1])
    return out.select(*rows.columns, "score")


def scan(docs: DataFrame, model: PipelineModel, threshold: float = THRESHOLD) -> DataFrame:
    """One row per candidate: doc_id, start, value, score, secret."""
    found = scored(candidates(docs), model)
    return found.select("doc_id", "start", "value", "score", (F.col("score") >= threshold).alias("secret"))


def redact(docs: DataFrame, model: PipelineModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with every secret's value replaced by MASK, all columns; n_chars follows the
    new text where there is such a column. Documents without a candidate never shuffle; the others
    meet the secrets found in equal texts."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    has = F.coalesce(F.col("text").rlike(FOUND), F.lit(False))
    some = docs.filter(has)
    texts = some.select(F.struct(F.col("doc_id"), key.alias("key")).alias("doc_id"), "text")
    found = scan(texts, model, threshold).filter("secret")
    # name= stays, the value goes: by its place, last first, and long values wherever else they occur;
    # longer values first, so that none is cut by a shorter one
    core = core_of(F.col("value"))
    place = (F.col("start") + F.char_length("value") - F.char_length(core)).alias("at")
    values = found.select("doc_id.*", place, core.alias("value")).distinct()
    each = F.struct("at", F.char_length("value").alias("n"), "value")
    lists = values.groupBy(F.col("doc_id").alias("s_id"), F.col("key").alias("s_key")).agg(F.collect_list(each).alias("s_values"))
    own = some.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col("doc_id").alias("own_id"), key.alias("own_key"), F.col("text").alias("own_text"),
    )
    joined = own.join(lists, F.col("own_id").eqNullSafe(F.col("s_id")) & (F.col("own_key") == F.col("s_key")), "left")
    every = F.coalesce("s_values", F.array().cast("array<struct<at:bigint,n:int,value:string>>"))
    by_place = F.aggregate(
        F.reverse(F.array_sort(every)),
        F.col("own_text"),
        lambda t, v: F.overlay(t, F.lit(MASK), (v["at"] + 1).cast("int"), v["n"]),
    )
    long = F.transform(F.filter(every, lambda v: v["n"] >= SHORT), lambda v: F.struct(v["n"].alias("n"), v["value"].alias("value")))
    text = F.aggregate(F.reverse(F.array_sort(F.array_distinct(long))), by_place, lambda t, v: F.replace(t, v["value"], F.lit(MASK)))
    out = joined.select(*[text.alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
    both = docs.filter(~has).unionByName(out)
    return both.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else both
