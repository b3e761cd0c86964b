"""Secret scans with a random forest against false positives (operator 5).

Candidates are strings of 16 and more letters, digits and a few signs, what is assigned to a name that speaks of a
secret, if it has six characters at least, and, each as a whole, web tokens, private keys in PEM armour, and passwords in addresses. Features: length, entropy, how often character
kinds change and which, the share covered by words that the corpus uses, the kind of path, and the words before it. The
forest is trained from labelled findings (``labelled_findings`` makes a bounded set of them from a seed, for the formats
that public detectors describe; any table of the same columns may be passed instead) and removes false positives.

Plan: candidates are cut out per document on the executors; the forest's scores are computed in the JVM.
"""

from __future__ import annotations

import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

LONG = rb"[A-Za-z0-9+/=_\-]{16,}"
ASSIGNED = rb"""(?i:token|secret|passw(?:or)?d|pwd|api_?key|access_?key|private_?key|credentials?)["']?[ \t]*(?::|=>?|:=)[ \t]*(?:"([^"\s]{6,})"|'([^'\s]{6,})'|([^\s"',;)}\]]{6,}))"""
#: Tokens of three parts joined by dots, keys in PEM armour as a whole, passwords in addresses; they come before the others, which would cut them up.
TOKEN = rb"(eyJ[A-Za-z0-9_\-]{8,}(?:\.[A-Za-z0-9_\-]{4,}){1,2})"
ARMOUR = rb"(-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s:,\-]{0,16384}?-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----)"
ADDRESS = rb"(?<![a-z0-9+.\-])[a-z][a-z0-9+.\-]{1,20}://[^\s:/@\"']{1,128}:([^\s@/\"']{3,256})@"
CANDIDATE = re.compile(b"|".join([ARMOUR, TOKEN, ADDRESS, ASSIGNED, b"(" + LONG + b")"]))
BEFORE = 40  # bytes
FINDINGS = 2_000
DICTIONARY = 5_000  # words
CLASSES = 8  # of counts of words, for each doubling
# fixed values: words that stand before secrets, words that stand before other strings, prefixes of keys
NAMES = (b"token", b"secret", b"password", b"passwd", b"pwd", b"api_key", b"apikey", b"access_key", b"auth", b"credential", b"private_key", b"client_secret")
OTHERS = (b"sha256", b"md5", b"commit", b"checksum", b"digest", b"uuid", b"id", b"hash", b"etag", b"build", b"example", b"placeholder")
PREFIXES = (b"AKIA", b"ghp_", b"xoxb-", b"sk_live_", b"AIza", b"glpat-", b"eyJ")
CODE_PATHS = ("py", "js", "env", "yml", "yaml", "json", "cfg", "ini", "sh", "config", "settings")
FEATURES = ("length", "entropy", "digits", "upper", "lower", "signs", "changes", "letter_digit", "case_changes", "vowels", "repeats", "covered", "prefix", "assigned", "quoted", "named", "other", "code_path")


KINDS = np.array([0 if 48 <= c <= 57 else 1 if 65 <= c <= 90 else 2 if 97 <= c <= 122 else 3 for c in range(256)], np.uint8)
VOWELS = np.array([c in b"aeiouAEIOU" for c in range(256)])


def candidates(text: bytes):
    """(start, string) in order; none lies in another."""
    for m in CANDIDATE.finditer(text):
        yield m.start(m.lastindex), m[m.lastindex]


def _covered(word: bytes, dictionary: set[bytes]) -> float:
    """Share of the characters in the longest-first cover by words of 4 to 12 letters."""
    low, at, hit = word.lower(), 0, 0
    while at < len(low):
        k = next((k for k in range(min(12, len(low) - at), 3, -1) if low[at : at + k] in dictionary), 0)
        hit, at = hit + k, at + max(1, k)
    return hit / max(1, len(low))


def features(candidate: bytes, before: bytes, path: str, dictionary: set[bytes]) -> list[float]:
    """Of the whole candidate, whatever its length."""
    n = len(candidate)
    letters = np.frombuffer(candidate, np.uint8)
    kinds = KINDS[letters]
    share = np.bincount(kinds, minlength=4) / n
    freq = np.unique(letters, return_counts=True)[1] / n
    a, b = kinds[:-1], kinds[1:]
    turn, low_high = a != b, np.minimum(a, b) * 4 + np.maximum(a, b)
    low = before.lower()
    tail = low.rstrip(b" \"'")
    return [
        float(n), float(-(freq * np.log2(freq)).sum()), *share.tolist(),
        float(turn.sum() / n), float(np.isin(low_high, (1, 2)).sum() / n), float((low_high == 6).sum() / n),
        float(VOWELS[letters].mean()), float(freq.max()), _covered(candidate, dictionary), float(candidate.startswith(PREFIXES)),
        float(tail.endswith((b"=", b":", b">"))), float(before.endswith((b'"', b"'"))), float(any(w in low for w in NAMES)), float(any(w in low for w in OTHERS)),
        float(path.lower().rpartition(".")[2] in CODE_PATHS),
    ]


def labelled_findings(seed: int = 5, n: int = FINDINGS) -> list[tuple[str, str, str, int]]:
    """(candidate, before, path, label) made from a seed: half secrets in known formats, half strings that look alike."""
    rng = random.Random(seed)
    pick = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    hexes, alnum, b64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    words = ["light", "house", "method", "stream", "report", "value", "number", "entry", "manager", "factory", "request", "handler", "service", "index", "table", "window"]
    password = lambda: rng.choice(words).capitalize()[: rng.randrange(2, 8)] + pick(string.digits, rng.randrange(1, 5)) + pick("!$#%&?*.", rng.randrange(0, 3)) + pick(alnum, rng.randrange(2, 8))
    secrets = [lambda: pick(hexes, rng.choice([32, 40, 64])), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + pick(alnum, 36), lambda: "xoxb-" + pick(string.digits, 12) + "-" + pick(alnum, 24), lambda: "sk_live_" + pick(alnum, 24), lambda: pick(b64, rng.choice([40, 44, 64])), lambda: pick(alnum, rng.randrange(18, 48)), password, password]
    whole = [  # secrets that need no name before them
        lambda: (".".join(["eyJ" + pick(alnum + "-_", rng.randrange(16, 60)), "eyJ" + pick(alnum + "-_", rng.randrange(20, 200)), pick(alnum + "-_", 43)]), rng.choice(["Bearer ", "token: ", "jwt ", "see "])),
        lambda: ("-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(pick(b64, 64) for _ in range(rng.randrange(6, 30))) + "\n-----END RSA PRIVATE KEY-----", rng.choice(["key: ", "", "\n"])),
        lambda: (password(), rng.choice(["postgres://", "https://", "amqp://", "redis://"]) + rng.choice(words) + ":"),
    ]
    harmless = [
        lambda: (pick(hexes, rng.choice([32, 40, 64])), rng.choice(["sha256: ", "commit ", "md5 ", "checksum ", "etag ", "digest: "])),
        lambda: ("-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)), rng.choice(["uuid ", "id: ", "build ", "in "])),
        lambda: (rng.choice(["_", "-", "", "/"]).join(rng.choice(words) for _ in range(rng.randrange(3, 7))), rng.choice(["the ", "see ", "in ", "call "])),
        lambda: (rng.choice(["x", "0", "-", "=", "_", "a"]) * rng.randrange(16, 60), rng.choice(["token = \"", "password: ", "the "])),
        lambda: (pick(string.digits, rng.randrange(16, 22)), rng.choice(["no. ", "card ", "call ", "id "])),
        lambda: ("YOUR_" + rng.choice(["API", "SECRET", "ACCESS"]) + "_KEY_GOES_HERE", rng.choice(["token = \"", "api_key = "])),
        lambda: ("".join(rng.choice(words).capitalize() for _ in range(rng.randrange(3, 7))), rng.choice(["class ", "new ", "use "])),
        lambda: (rng.choice(words) + rng.choice(["", "s", "_", "()", "." + rng.choice(words)]) + rng.choice(words), rng.choice(["token = ", "secret: ", "password: ", "api_key = "])),
        lambda: (rng.choice(["${" + rng.choice(words).upper() + "_TOKEN}", "changeme", "<password>", "xxxxxxxx", "********", "password", "os.environ[KEY]", "undefined"]), rng.choice(["password = \"", "token: ", "secret = '"])),
    ]
    found = []
    for k in range(n):
        path = rng.choice(["src0", "notes.txt", "app/settings.py", "deploy.yml", ".env", "a.md"])
        if k % 20 == 1:
            c, before = rng.choice(whole)()
            found.append((c, f"{rng.choice(words)} {before}", path, 1))
        elif k % 2:
            c, name = rng.choice(secrets)(), rng.choice(NAMES).decode()
            found.append((c, f"{rng.choice(words)} {name}" + rng.choice([' = "', ": ", "=", " = '", '": "', " "]), path, 1))
        else:
            c, before = rng.choice(harmless)()
            found.append((c, f"{rng.choice(words)} {before}", path, 0))
    return [f for f in found if len(f[0]) >= 6]


def corpus_words(docs: DataFrame, text_col="text") -> set[bytes]:
    """The DICTIONARY commonest words of 4 to 12 letters, counted over all documents; ties by the word. Counts are written;
    how many words have how large a count (one row per class of counts) tells below which no word can be among them, so
    that tasks don't each send as many words as there are in the dictionary."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"\b([a-z]{4,12})\b"), 1)).alias("w"))
    counts = written(words.groupBy("w").count().withColumn("class", F.floor(F.log2("count") * CLASSES).cast("int")), "words")
    least, seen = 0, 0
    for r in counts.groupBy("class").agg(F.count("*").alias("n")).orderBy(F.desc("class")).collect():  # some 8 * 40 rows at most
        least, seen = r["class"], seen + r["n"]
        if seen >= DICTIONARY:
            break
    return {r["w"].encode() for r in counts.filter(F.col("class") >= least).orderBy(F.desc("count"), "w").limit(DICTIONARY).collect()}


def train(spark: SparkSession, dictionary: set[bytes], findings=None, trees: int = 24, depth: int = 8) -> RandomForestClassificationModel:
    rows = [(float(y), *features(c.encode(), b.encode(), p, dictionary)) for c, b, p, y in (findings or labelled_findings())]
    frame = spark.createDataFrame(rows, ["label", *FEATURES])
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=3).fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(frame))


def scan(docs: DataFrame, model: RandomForestClassificationModel, dictionary: set[bytes], id_col="doc_id", text_col="text", path_col="source") -> DataFrame:
    """(id, start, candidate, probability) of all candidates; start counts bytes. Null and empty texts have none, a null path
    counts as ''; repeated rows give repeated findings; ids may be null; an empty table gives no rows. Texts and candidates
    may be of any length. Other columns are left out, whatever their names. ``path_col`` is where a text comes from; what
    has no extension of a file of code (as the sources of ``documents``) is taken for prose."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(dictionary)

    def cut(batches):
        for b in batches:
            ids, rows = [], []
            for i, t, p in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                for start, found in candidates(t or b""):
                    ids.append(i)
                    rows.append((start, found.decode(), *features(found, t[max(0, start - BEFORE) : start], p or "", held.value)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), *[pa.array([r[k + 2] for r in rows], pa.float64()) for k in range(len(FEATURES))]], names=["id", "start", "candidate", *FEATURES])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(path_col).cast("string").alias("path"))
    found = rows.mapInArrow(cut, f"id {kind}, start long, candidate string, " + ", ".join(f"{f} double" for f in FEATURES))
    scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found))
    return scored.select("id", "start", "candidate", vector_to_array("probability")[1].alias("probability"))


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionary = corpus_words(docs)
    found = scan(docs, train(spark, dictionary), dictionary)
    return found.select(F.col("id").alias("doc_id"), "start", F.sha2("candidate", 256).alias("candidate_sha256"), F.length("candidate").alias("length"), F.round("probability", 6).alias("probability"), (F.col("probability") >= 0.5).alias("secret"))
