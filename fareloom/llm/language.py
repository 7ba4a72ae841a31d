"""Language identification in two steps: the family first, then one-versus-one machines inside the family.

Features are hashed counts of one to three letters of the whole lower-cased text (other characters are one
separator), as square roots of frequencies. A linear support vector machine per family (one against the rest) picks
the family; inside it a linear support vector machine per pair of languages votes. Languages the family table
doesn't list are families of their own.

The machines are fitted on the driver from at most about `SAMPLE` labelled documents, a hash sample with an equal
share for each of the `LANGUAGES` most frequent labels; nothing else is bounded. Only text and label enter.

A text that is null or has no letter is `und` with score 0, and so is every text if nothing could be learned. The
score is the certainty of the weaker step times the share of the text's letters that the sample had, so a script
that was never seen scores 0.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .batches import map_batches

UNKNOWN = "und"
#: Labelled documents that are collected to fit the machines, and the labels that are learned.
SAMPLE = 2400
LANGUAGES = 256
#: Number of hashed features.
WIDTH = 4096
#: Characters that are counted at once.
STRIDE = 1 << 20
#: Score below which the pipeline rejects a document: half of the letters known, or a certainty hardly given.
MIN_SCORE = 0.25

#: Members of language families by two-letter code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af fy lb".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl bs mk".split(),
    "turkic": "tr az kk ky uz tk tt".split(),
    "indo-aryan": "hi ur bn mr ne gu pa".split(),
    "uralic": "fi et hu".split(),
    "semitic": "ar he mt am".split(),
}


def family(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((f for f, members in FAMILIES.items() if code in members), lang)


class Features:
    def __init__(self):
        import numpy as np

        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)

    def __call__(self, text: str | None, seen=None):
        """Square roots of n-gram frequencies, and the share of letters in the table `seen`; None without a letter.

        Without `seen`, the distinct letters instead of the share.
        """
        import numpy as np

        if not text:
            return None
        counts, letters, familiar, distinct = np.zeros(WIDTH), 0, 0, [np.empty(0, np.uint32)]
        for low in range(0, len(text), STRIDE):
            part = text[max(0, low - 2) : low + STRIDE].lower()
            codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
            known = self.letter[codes]
            own = codes[known]
            letters += len(own)
            if seen is None:
                distinct.append(np.unique(own))
            else:
                familiar += int(np.count_nonzero(seen[own]))
            a = np.empty(len(codes) + 2, np.uint32)
            a[0] = a[-1] = 32
            a[1:-1] = np.where(known, codes, 32)
            two = a[:-1] * np.uint32(0x9E3779B1) + a[1:] * np.uint32(0x85EBCA77)
            three = two[:-1] * np.uint32(0xC2B2AE3D) + a[2:] * np.uint32(0x27D4EB2F)
            for n, h in enumerate((a * np.uint32(0x165667B1), two, three)):
                h = (h ^ np.uint32(n)) * np.uint32(0x2C1B3C6D)
                counts += np.bincount(h >> np.uint32(20), minlength=WIDTH)
        if not letters:
            return None
        vector = np.sqrt(counts / counts.sum()).astype(np.float32)
        return vector, np.unique(np.concatenate(distinct)) if seen is None else min(1.0, familiar / letters)


def fit_machine(x, positive, rounds: int = 300, penalty: float = 1e-4):
    """Weights (bias last) of a linear machine with squared hinge loss, both sides weighing the same."""
    import numpy as np

    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    share = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())).astype(np.float32)
    w = ahead = np.zeros(x.shape[1], np.float32)
    step, t = 0.2, 1.0
    for _ in range(rounds):  # accelerated gradient steps
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - step * (penalty * ahead - 2 * (x.T @ (share * y * slack)))
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead, w = new + (old - 1) / t * (new - w), new
    return w


class Machines:
    """families: names in order; members: languages of each; weights: one column per family, then per pair.

    letters: those of the sample.
    """

    def __init__(self, x, langs: list[str], letters):
        import numpy as np

        self.letters = letters
        labels = np.array(langs)
        known = sorted(set(langs))
        self.families = sorted({family(k) for k in known})
        self.members = {f: [k for k in known if family(k) == f] for f in self.families}
        of = np.array([family(k) for k in langs])
        columns = [fit_machine(x, of == f) for f in self.families]
        self.pairs: dict[str, list[tuple[int, int, int]]] = {}
        for f in self.families:
            self.pairs[f] = []
            for a, b in combinations(range(len(self.members[f])), 2):
                own = (labels == self.members[f][a]) | (labels == self.members[f][b])
                self.pairs[f].append((a, b, len(columns)))
                columns.append(fit_machine(x[own], labels[own] == self.members[f][a]))
        self.weights = np.stack(columns, axis=1)

    def predict(self, features) -> tuple[str, float]:
        """The language and how sure it is: the lesser of the certainties of both steps."""
        import numpy as np

        margins = features @ self.weights[:-1] + self.weights[-1]
        sure = lambda m: float(1 / (1 + np.exp(-np.clip(4 * m, -50, 50))))
        own = margins[: len(self.families)]
        best = int(np.argmax(own))
        name = self.families[best]
        members = self.members[name]
        score = sure(own[best]) if len(self.families) > 1 else 1.0
        votes, sums = [0] * len(members), [0.0] * len(members)
        for a, b, column in self.pairs[name]:
            m = float(margins[column])
            votes[a if m >= 0 else b] += 1
            sums[a], sums[b] = sums[a] + m, sums[b] - m
        winner = max(range(len(members)), key=lambda i: (votes[i], sums[i], -i))
        if len(members) > 1:
            against = min(m if a == winner else -m for a, b, c in self.pairs[name] if winner in (a, b) for m in [float(margins[c])])
            score = min(score, sure(against))
        return members[winner], score


def training_remainder() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3


def fit(docs: DataFrame, remainder: int = 1) -> Machines | None:
    """Machines learned from labelled `docs` (doc_id, text, lang) but those of the given remainder."""
    import numpy as np

    known = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where((training_remainder() != remainder) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return None
    quota = max(2, SAMPLE // len(counts))
    limits = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(1.0, quota / r["count"]))])
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 24)) / float(1 << 24)
    sample = known.where(place < F.coalesce(limits[F.col("lang")], F.lit(0.0)))

    def extract(batches):
        import pyarrow as pa

        features = Features()
        for b in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            rows = [(i, k, f) for i, t, k in zip(*(c.to_pylist() for c in b.columns)) if (f := features(t))]
            data = [pa.array([r[n] for r in rows], kind) for n, kind in enumerate((pa.int64(), pa.string()))]
            data.append(pa.array([f[0].astype(np.float16).tobytes() for _, _, f in rows], pa.binary()))
            data.append(pa.array([f[1].tobytes() for _, _, f in rows], pa.binary()))
            yield pa.RecordBatch.from_arrays(data, ["doc_id", "lang", "features", "letters"])

    narrow = sample.select(F.col("doc_id").cast("long"), "text", "lang")
    rows = map_batches(narrow, extract, "doc_id long, lang string, features binary, letters binary").limit(2 * SAMPLE).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.doc_id, r.lang, bytes(r.features)))
    x = np.stack([np.frombuffer(bytes(r.features), np.float16) for r in rows]).astype(np.float32)
    letters = np.unique(np.concatenate([np.frombuffer(bytes(r.letters), np.uint32) for r in rows]))
    return Machines(x, [r.lang for r in rows], letters)


def identify(docs: DataFrame, machines: Machines | None, added: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`docs` with lang_pred and score added under the names `added`; columns of these names are replaced."""
    docs = docs.drop(*added)
    names = docs.columns
    schema = StructType([*docs.schema.fields, StructField(added[0], StringType()), StructField(added[1], DoubleType())])
    at = names.index("text")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        features, seen = Features(), np.zeros(0x110000, bool)
        if machines:
            seen[machines.letters] = True
        for b in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            found = []
            for t in b.column(at).to_pylist():
                if machines and (f := features(t, seen)):
                    lang, score = machines.predict(f[0])
                    found.append((lang, score * f[1]))
                else:
                    found.append((UNKNOWN, 0.0))
            columns = [*b.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, *added])

    return map_batches(docs, run, schema)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of the labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    held_out = F.coalesce(training_remainder() == 1, F.lit(False)).alias("held_out")
    return identify(narrow, fit(docs)).select("doc_id", held_out, "lang_pred", "score")
