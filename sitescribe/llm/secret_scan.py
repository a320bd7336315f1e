"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are long unbroken tokens and what is assigned to names like ``password``.  The forest
judges a candidate's length, the transitions between kinds of characters, how much of it a
dictionary covers, its path and the words around it.  It is trained from labelled findings.
"""

from __future__ import annotations

import hashlib
import math
import random
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import small_batches, utf8

#: Bytes before a candidate in which neighbouring words are looked for.
NEIGHBOURHOOD = 48
#: A finding whose probability is lower is a false positive.
LEAST_PROBABILITY = 0.5

# Words by what they say about a candidate beside them.
CREDENTIAL_WORDS = "password passwd pwd passphrase secret token apikey api_key api-key access_key private_key auth bearer credential aws key".split()
HARMLESS_WORDS = "example sample dummy placeholder test fake changeme checksum sha256 sha1 md5 commit uuid digest etag version build".split()
HARMLESS_PATHS = "test example sample doc fixture mock vendor".split()

# A long token; what is assigned to a name that holds one of these words; the password of an address.
_TOKEN = regex.compile(rb"[A-Za-z0-9_\-+/=.]{16,}+")
_ASSIGNED = regex.compile(rb"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth)[A-Za-z0-9_\-]{0,20}+[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"',;]{6,})")
_ADDRESS = regex.compile(rb"://[^\s/:@]{1,64}+:([^\s/@]{6,128}+)@")
_KINDS = bytes(0 if chr(b).islower() and b < 128 else 1 if chr(b).isupper() and b < 128 else 2 if chr(b) in string.digits else 3 for b in range(256))
_CONTINUED = bytes(range(0x80, 0xC0))
FEATURES = 6 + 16 + 5


def _apart(matches: Iterator, taken: list[tuple[int, int]], group: int) -> Iterator[tuple[int, int]]:
    """Spans of matches that overlap none of ``taken``; both are in order, so one pass over each is enough."""
    k = 0
    for m in matches:
        start, end = m.span(group)
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if k == len(taken) or taken[k][0] >= end:
            yield start, end


def candidates(raw: bytes) -> list[tuple[int, int, str]]:
    """(start, end, pattern) of each candidate, left to right; an address's value wins over an assignment's, and both over a token.

    So no two overlap, and no two begin at one place.
    """
    found = {m.span(1): "address" for m in _ADDRESS.finditer(raw)}
    found |= dict.fromkeys(list(_apart(_ASSIGNED.finditer(raw), sorted(found), 1)), "assigned")
    found |= dict.fromkeys(list(_apart(_TOKEN.finditer(raw), sorted(found), 0)), "token")
    return [(a, b, found[a, b]) for a, b in sorted(found)]


def code_points(raw: bytes) -> int:
    """Of UTF-8: bytes that begin a character."""
    return len(raw.translate(None, _CONTINUED))


def features(value: bytes, before: bytes, after: bytes, path: str, dictionary: frozenset[bytes]) -> list[float]:
    n, kinds = len(value), value.translate(_KINDS)
    counts = Counter(value)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0
    steps = Counter(zip(kinds, kinds[1:], strict=False))
    low = value.lower()
    grams = [low[i : i + 3] for i in range(n - 2) if low[i : i + 3].isalpha()]
    covered = sum(g in dictionary for g in grams) / max(1, n - 2)
    near, beyond, path = before.lower().decode("utf-8", "replace"), after.lower().decode("utf-8", "replace"), path.lower()
    shares = [kinds.count(k) / max(1, n) for k in (0, 2, 3)]
    return [
        float(n), entropy, covered, *shares,
        *(steps[a, b] / max(1, n - 1) for a in range(4) for b in range(4)),
        float(any(w in near for w in CREDENTIAL_WORDS)), float(any(w in near or w in beyond for w in HARMLESS_WORDS)),
        float(near.rstrip(" \"'")[-1:] in ("=", ":")), float(any(w in path for w in HARMLESS_PATHS)), float(any(w.encode() in low for w in HARMLESS_WORDS)),
    ]


def labelled_findings(n: int = 3000, seed: int = 3) -> list[tuple[bytes, bytes, bytes, str, int]]:
    """(value, before, after, path, is secret): findings made from known shapes of secrets and of
    harmless look-alikes, for want of a labelled table.  Any rows of this shape train as well."""
    rng = random.Random(seed)
    pick = lambda alphabet, k: "".join(rng.choices(alphabet, k=k))
    hexes, alnum, word = "0123456789abcdef", string.ascii_letters + string.digits, lambda: pick("etaoinshrdlu", rng.randint(2, 9))
    base64 = alnum + "+/"
    out = []
    for _ in range(n):
        before, after = " ".join(word() for _ in range(5)), " ".join(word() for _ in range(5))
        secret = rng.random() < 0.5
        path = rng.choice(["src", "config", "app", "lib", "src7", "deploy"])
        if secret:
            value, name = rng.choice([
                lambda: ("AKIA" + pick(string.ascii_uppercase + string.digits, 16), ""), lambda: (pick(hexes, rng.choice([18, 20, 32, 40, 64])), "token = \""),
                lambda: (pick(hexes, rng.randint(12, 24)), "password="), lambda: (pick(alnum, rng.randint(20, 48)), "secret: "),
                lambda: ("ghp_" + pick(alnum, 36), ""), lambda: (pick(base64, 40), "aws key="), lambda: ("sk-" + pick(alnum, 40), "api_key="), lambda: (pick(alnum, rng.randint(8, 16)) + "7", "DB_PASSWORD=\""), lambda: (word() + pick(string.digits, 2), "\"password\": \""),
                lambda: (word() + pick(alnum, 4) + "9", "postgres://app:"), lambda: (pick(string.ascii_letters, rng.randint(24, 40)), "client_secret = \""), lambda: (pick(alnum, 12), "client_secret = \""), lambda: (pick(alnum + "!#%", rng.randint(9, 18)) + "7", "pwd="),
            ])()
            before += " " + name
        else:
            value, name = rng.choice([
                lambda: ("-".join(word() for _ in range(4)) + pick(string.digits, 2), " "), lambda: ("/".join(word() for _ in range(4)) + "/" + pick(string.digits, 3), "see "),
                lambda: (pick(hexes, 40), "commit "), lambda: (pick(hexes, 64), "sha256 checksum: "), lambda: ("-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)), "uuid "),
                lambda: (rng.choice(["changeme", "example", "placeholder", "your-password", "xxxxxxxx", "********", "none", "required"]), "password="),
                lambda: (word() + word() + word(), "token: "), lambda: (f"{rng.randint(1990, 2030)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T10.{pick(string.digits, 4)}", "at "),
                lambda: (pick(string.digits, rng.randint(16, 22)), "number "), lambda: ("".join(word() for _ in range(rng.randint(3, 7))), " "), lambda: ("/".join(word() for _ in range(5)), "see "), lambda: (word() + word(), "the secret: "), lambda: ("=" * rng.randint(16, 40) + "1", " "), lambda: ("1." + pick(string.digits, 2) + "." + word() + word() + word(), "version "),
            ])()
            before += " " + name
            path = rng.choice([path, "test", "docs/example"])
        out.append((value.encode(), before[-NEIGHBOURHOOD:].encode(), after.encode(), path, int(secret)))
    return out


def findings_of(table: DataFrame, most: int = 20_000) -> list[tuple[bytes, bytes, bytes, str, int]]:
    """Labelled findings of ``table(value, before, after, path, is_secret)`` to train on: ``most`` at most, the first by a hash of the value."""
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("value", "before", "after", "path")]
    rows = table.where("value is not null and is_secret is not null").select(*texts, F.col("is_secret").cast("int").alias("is_secret"))
    chosen = rows.orderBy(F.xxhash64("value"), *rows.columns).limit(most).collect()
    return [(utf8(r.value), utf8(r.before)[-NEIGHBOURHOOD:], utf8(r.after)[:NEIGHBOURHOOD], r.path, r.is_secret) for r in chosen]


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, n): how often each three small letters follow each other in one partition, as numbers to base 26."""
    counts = np.zeros(26**3, dtype=np.int64)
    for batch in batches:
        for text in batch.column("text").to_pylist():
            x = np.frombuffer(utf8(text), dtype=np.uint8).astype(np.int32) - 97
            fits = (x >= 0) & (x < 26)
            if len(x) > 2:
                fits = fits[:-2] & fits[1:-1] & fits[2:]
                counts += np.bincount(((x[:-2] * 26 + x[1:-1]) * 26 + x[2:])[fits], minlength=26**3)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen])], ["g", "n"])


def word_trigrams(docs: DataFrame, share: float = 1e-4) -> frozenset[bytes]:
    """The dictionary: sequences of three small letters that make up ``share`` of all of them or more in all
    texts; 26^3 at most, counted where the texts are."""
    counted = docs.select("text").where("text is not null").mapInArrow(_trigrams, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()
    total = sum(r["n"] for r in counted)
    return frozenset(bytes((97 + r["g"] // 676, 97 + r["g"] // 26 % 26, 97 + r["g"] % 26)) for r in counted if r["n"] >= share * total)


def train_forest(spark: SparkSession, findings: list[tuple], dictionary: frozenset[bytes], seed: int = 1) -> RandomForestClassificationModel:
    rows = [(features(*f[:4], dictionary), float(f[4])) for f in findings]
    frame = spark.createDataFrame(rows, "features array<double>, label double").select(array_to_vector("features").alias("features"), "label")
    return RandomForestClassifier(numTrees=40, maxDepth=8, seed=seed).fit(frame)


def _scan(shared, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = shared.value
        for batch in batches:
            rows = []
            for doc_id, path, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "_path", "text")), strict=True):
                raw, at, counted = utf8(text), 0, 0
                for start, end, pattern in candidates(raw):
                    value, before, after = raw[start:end], raw[max(0, start - NEIGHBOURHOOD) : start], raw[end : end + NEIGHBOURHOOD]
                    at, counted = at + code_points(raw[counted:start]), start
                    rows.append((doc_id, at, code_points(value), pattern, hashlib.sha256(value).hexdigest(), features(value, before, after, path or "", dictionary)))
            kinds = (id_type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.float64()))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            names = ["doc_id", "start", "length", "pattern", "sha256", "_features"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def scanned(docs: DataFrame, model: RandomForestClassificationModel, dictionary: frozenset[bytes], path: str = "source") -> DataFrame:
    """(doc_id, start, length, pattern, sha256, probability, is_secret): one row for each candidate.

    ``start`` and ``length`` count code points; the candidate itself is given by its digest only.
    Whole texts are searched, in time that grows with their length; null and empty texts and texts without candidates give no row, so
    does an empty table.  Repeated rows give repeated findings.  A null ``doc_id`` is kept.  Only
    ``doc_id``, ``text`` and the column named by ``path`` are read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dictionary)
    rows = docs.select("doc_id", F.col(path).cast("string").alias("_path"), "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(_scan(shared, to_arrow_type(rows.schema["doc_id"].dataType)), f"doc_id {id_type}, start long, length long, pattern string, sha256 string, _features array<double>")
    judged = model.transform(found.withColumn("features", array_to_vector("_features")))
    judged = judged.withColumn("probability", vector_to_array("probability")[1])
    return judged.select("doc_id", "start", "length", "pattern", "sha256", "probability", (F.col("probability") >= LEAST_PROBABILITY).alias("is_secret"))
