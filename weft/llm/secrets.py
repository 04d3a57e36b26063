"""Secret scan: candidate strings, and a random forest that removes false positives.

Candidates are runs of twelve or more letters, digits and ``+/_-`` (and closing ``=``) with a letter and a
digit among them. Features: length, shares and transitions of character classes, the share of the
candidate that dictionary words cover, signs of a path around it, and the words next to it. The dictionary
is counted over all documents: runs of four or more letters that make up a share ``DICTIONARY`` of all such runs
(and occur twice), so that it means the same at every size. The forest is trained from a table of labelled findings, whose
coverage is computed with the same dictionary; ``labelled_findings`` makes one (``FINDINGS`` rows) of known kinds of keys and
of look-alikes, which are built of the corpus's own commonest words. Everything is DataFrame functions and Spark's own forest.

Defined results: null and empty texts have no candidates; texts and candidates of any length are read
whole; repeated rows and repeated candidates are findings of their own; null ids are kept; an empty table
gives no findings; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable

CANDIDATE = r"[A-Za-z0-9+/_-]{12,}={0,2}"
DICTIONARY = 1e-5
#: Words of the dictionary that look-alikes are built of, at most; and words for a corpus without such (fixed values).
PROSE = 64
PLAIN = ("request", "handler", "server", "module", "report", "release", "station", "content", "window", "market", "player", "number", "garden", "summer", "record", "letter")
FINDINGS = 12_000
TREES, DEPTH, SEED = 24, 9, 7
CUTOFF = 0.5
#: Words whose presence beside a candidate speaks for or against a secret (fixed values).
FOR = "key|token|secret|passw|pwd|auth|bearer|credential|apikey|private|akia"
AGAINST = "sha|commit|md5|digest|checksum|uuid|guid|hash|etag|version|build|order|invoice|example|sample|path|file|http|www"


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, word, part, token, before, earlier, after, candidate) for each candidate of each text."""
    body = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), body.alias("t")).filter(F.col("t").rlike(CANDIDATE))
    rows = rows.select("doc_id", F.split("t", r"[\x20\x09-\x0D]+").alias("w"))
    near = lambda i, d: F.coalesce(F.get("w", i + d), F.lit(""))
    one = lambda x, i: F.when(x.rlike(CANDIDATE), F.struct(i.cast("long").alias("word"), x.alias("token"), near(i, -1).alias("before"), near(i, -2).alias("earlier"), near(i, 1).alias("after")))
    found = rows.select("doc_id", F.explode(F.filter(F.transform("w", one), lambda s: s.isNotNull())).alias("s")).select("doc_id", "s.*")
    found = found.select("*", F.posexplode(F.regexp_extract_all("token", F.lit(CANDIDATE), F.lit(0))).alias("part", "candidate"))
    return found.filter(F.col("candidate").rlike("[0-9]") & F.col("candidate").rlike("[A-Za-z]"))


def dictionary(docs: DataFrame, text: str = "text", share: float = DICTIONARY) -> DataFrame:
    """(entry, n): lower-case runs of four or more letters that are ``share`` of all such runs, and occur twice, in all texts."""
    runs = F.split(F.lower(F.col(f"`{text}`").cast("string")), "[^a-z]+")
    words = docs.select(F.explode(F.filter(runs, lambda w: F.length(w) >= 4)).alias("entry"))
    counts = durable(words.groupBy("entry").agg(F.count(F.lit(1)).alias("n")), "runs")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.filter(F.col("n") >= max(2.0, share * total))


def common_words(entries: DataFrame) -> list[str]:
    """The commonest entries of five to ten letters, PROSE at most."""
    found = entries.filter(F.length("entry").between(5, 10)).orderBy(F.desc("n"), "entry").limit(PROSE).collect()
    return [r["entry"] for r in found] or list(PLAIN)


def covered(found: DataFrame, entries: DataFrame) -> DataFrame:
    """``found`` with the share of each candidate that dictionary words cover."""
    distinct = found.select("candidate").distinct()
    runs = distinct.select("candidate", F.explode(F.filter(F.split(F.lower("candidate"), "[^a-z]+"), lambda w: F.length(w) >= 4)).alias("entry"))
    share = F.sum(F.length("entry")) / F.max(F.length("candidate"))
    shares = runs.join(entries.select("entry"), "entry").groupBy("candidate").agg(share.alias("coverage"))
    return found.drop("coverage").join(shares, "candidate", "left").fillna(0.0, ["coverage"])


def features() -> dict[str, Column]:
    c = F.col("candidate")
    size = F.length(c).cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / size
    step = lambda a, b: share(f"(?<=[{a}])(?=[{b}])")
    kinds = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "sign": "+/_=-"}
    beside = F.lower(F.concat_ws(" ", "earlier", "before", F.split_part("token", F.col("candidate"), F.lit(1))))
    flag = lambda x: x.cast("double")
    out = {"size": size, "coverage": F.col("coverage")}
    out |= {f"share_{k}": share(f"[{v}]") for k, v in kinds.items()}
    out |= {f"step_{a}_{b}": step(kinds[a], kinds[b]) for a in kinds for b in kinds if a != b and "sign" not in (a, b)}
    out |= {
        "step_vowel": step("aeiouAEIOU", "bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ"),
        "step_rare": share("(?i)(?<=[bcdfghjklmnpqrstvwxz])(?=[bcdfghjklmnpqrstvwxz]{2})"),
        "repeats": share(r"(.)(?=\1)"),
        "rising": share("(?i)01|12|23|34|45|56|67|78|89|ab|bc|cd|de|ef"),
        "hex": flag(c.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
        "uuid": flag(F.col("token").rlike("(?i)[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}")),
        "slashes": F.regexp_count("token", F.lit(r"[/\\]")).cast("double"),
        "dots": F.regexp_count("token", F.lit(r"\.")).cast("double"),
        "file": flag(F.col("token").rlike(r"(?i)^(\.{0,2}/|[a-z]:\\|https?:)|\.[a-z]{2,4}$")),
        "mail": flag(F.col("token").rlike("@")),
        "assigned": flag(F.col("token").rlike("[=:]") | F.col("before").rlike("[=:]$")),
        "quoted": flag(F.col("token").rlike("[\"'`]")),
        "for": flag(beside.rlike(FOR)),
        "against": flag(beside.rlike(AGAINST)),
        "after_against": flag(F.lower("after").rlike(AGAINST)),
        "known_start": flag(c.rlike("^(AKIA|ASIA|ghp_|gho_|xox[bp]-|sk_live_|AIza|glpat-)")),
    }
    return out


def with_features(found: DataFrame) -> DataFrame:
    made = features()
    # values stand in columns of their own: the assembler leaves the findings as they are
    rows = found.select("*", *[x.cast("double").alias(f"f_{k}") for k, x in made.items()])
    return VectorAssembler(inputCols=[f"f_{k}" for k in made], outputCol="features", handleInvalid="keep").transform(rows).drop(*[f"f_{k}" for k in made])


def labelled_findings(spark: SparkSession, rows: int = FINDINGS, seed: int = 1, words=PLAIN) -> DataFrame:
    """(token, before, earlier, after, candidate, label): half keys of known kinds, half look-alikes made of ``words``.

    Built from hashes of the row number and the seed.
    """
    n = F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))
    hash_ = lambda tag: F.sha2(F.concat_ws(":", n, F.lit(tag)), 256)
    number = lambda tag, m: F.pmod(F.xxhash64(n, F.lit(tag)), F.lit(m)).cast("int")
    pick = lambda tag, options: F.element_at(F.array(*[F.lit(o) for o in options]), number(tag, len(options)) + 1)
    mixed = lambda tag: F.regexp_replace(F.base64(F.unhex(hash_(tag))), "[+/=]", "x")
    upper = F.upper(F.conv(F.substring(hash_("u"), 1, 15), 16, 36))
    padded = F.rpad(F.concat(upper, F.upper(F.conv(F.substring(hash_("v"), 1, 15), 16, 36))), 16, "Q7")
    hex_ = lambda tag, a, b: F.substr(hash_(tag), F.lit(1), number(tag + "n", b - a) + a)
    word = lambda tag: pick(tag, list(words))
    key = pick("key", ["password", "token", "secret", "api_key", "auth", "pwd", "apikey", "access_key"])
    prose = pick("prose", ["the", "of", "and", "der", "les", "para", "in", "to", "with", "see"])
    other = pick("other", ["commit", "sha256", "checksum", "build", "uuid", "version", "order", "digest", "etag", "invoice"])
    kinds = [
        (1, F.concat(F.lit("AKIA"), F.substring(padded, 1, 16)), "", "", "", prose),
        (1, hex_("a", 16, 41), F.concat(key, F.lit("=")), "", "", prose),
        (1, hex_("b", 32, 65), F.lit('"'), '"', "", F.lit("=")),
        (1, F.substring(mixed("c"), 1, 40), F.concat(key, F.lit(":")), "", "", prose),
        (1, F.concat(pick("p", ["ghp_", "sk_live_", "xoxb-", "glpat-"]), F.substring(mixed("d"), 1, 32)), "", "", "", prose),
        (1, F.substring(mixed("e"), 1, 32), F.lit("'"), "'", "", F.concat(key, F.lit(":"))),
        (0, F.concat_ws("-", F.substring(hash_("g"), 1, 8), F.substring(hash_("g"), 9, 4), F.substring(hash_("g"), 13, 4), F.substring(hash_("g"), 17, 4), F.substring(hash_("g"), 21, 12)), "", "", "", prose),
        (0, hex_("h", 32, 65), "", "", "", other),
        (0, F.concat(word("i"), F.lit("-"), word("j"), F.lit("-"), number("k", 100).cast("string")), F.lit("/usr/lib/"), ".js", "", prose),
        (0, F.concat(F.initcap(word("l")), F.initcap(word("m")), number("o", 100).cast("string"), F.initcap(word("q"))), "", "", "", prose),
        (0, F.concat(F.lit("example-"), word("r"), F.lit("-"), F.lit("123456")), F.concat(key, F.lit("=")), "", "", prose),
        (0, F.concat(F.lit("INV-2023-"), F.lpad(number("s", 100000).cast("string"), 8, "0")), "", "", "", other),
        (0, F.concat(F.substring(F.lit("abcdefabcdefabcdef"), 1, 6), F.lit("1234567890")), F.concat(key, F.lit("=")), "", "", prose),
        (0, F.concat(word("t"), F.lit("/"), word("w"), F.lit("/"), word("x"), number("y", 10).cast("string")), F.lit("https://www.example.com/"), "", "", prose),
    ]
    kind = F.when(F.col("id") % 2 == 0, number("kind", 6)).otherwise(number("kind", 8) + 6)
    pairs = [F.struct(F.lit(y).alias("label"), c.alias("candidate"), F.concat(F.lit(a) if isinstance(a, str) else a, c, F.lit(b)).alias("token"), F.lit(after).alias("after"), before.alias("before")) for y, c, a, b, after, before in kinds]
    chosen = spark.range(rows).select("id", F.element_at(F.array(*pairs), kind + 1).alias("s"), F.when(F.col("id") % 4 == 0, key).otherwise(prose).alias("around"))
    made = chosen.select("s.*", F.when(F.col("s.before") == "=", F.col("around")).otherwise("").alias("earlier"))
    return made


def train(findings: DataFrame, entries: DataFrame) -> RandomForestClassificationModel:
    """The forest of labelled findings (token, before, earlier, after, candidate, label) under a dictionary (entry)."""
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label", minInstancesPerNode=4)
    rows = durable(covered(findings, entries), "findings")
    model = forest.fit(with_features(rows).select("features", F.col("label").cast("double").alias("label")))
    return model.copy()  # without the training summary, whose session can't be sent to tasks once it has observed metrics


def scan(docs: DataFrame, findings: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, word, part, candidate, score, predicted) of every candidate of every text."""
    entries = durable(dictionary(docs, text), "dictionary")
    model = train(labelled_findings(docs.sparkSession, words=common_words(entries)) if findings is None else findings, entries)
    found = durable(candidates(docs, key, text), "candidates")
    found = covered(found, entries)
    scored = model.transform(with_features(found))
    score = vector_to_array("probability")[1]
    return scored.select("doc_id", "word", F.col("part").cast("int").alias("part"), "candidate", score.alias("score"), (score >= CUTOFF).cast("int").alias("predicted"))
