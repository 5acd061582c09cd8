"""Mixing sources to target weights by soft membership.

A softmax classifier over hashed byte trigrams and a few text ratios, trained in numpy on a
bounded sample of a labelled table (``SAMPLE_DOCS`` documents), gives each document a posterior
over domains. Nonnegative document rates r are then fitted so that the expected tokens of each
domain, ``sum_i r_i n_i p_id``, meet its target: projected-gradient least squares, preconditioned
by the domains' Gram matrix over the documents whose rate is above 0, where each step is one
distributed sum and the driver holds one vector of domains per step. Steps go on until the totals
meet the targets within ``TOLERANCE``, or no step brings them nearer by a thousandth: the problem
is convex, so they are then on the slow last way to its least-squares optimum. Wanted and reached totals are kept. A document's rate follows from
its posterior and the steps' vectors, so nothing is kept per document between steps. The rates
take effect as copies: the whole part, and one more with the rest's probability by a hash of the id.

Defined results: null and empty texts have no tokens and keep rate 1; null ids hash alike;
repeated rows are each a document; labels that are null are ignored; without labels there is
one domain and every rate is 1; extra columns are kept by ``resample``; an empty table gives an
empty table; very long texts are counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, tidied

SAMPLE_DOCS, SPLIT_SALT, BITS = 4_000, 11, 12
TOLERANCE, MOST_STEPS, NEAR = 1e-4, 200, 1e-3
RATIOS, RATIO_WEIGHT = 6, 2.0
_EPOCHS, _RATE, _L2 = 400, 0.2, 1e-4


def text_features(text: str | None):
    """The number of words, and the features: square roots of the counts of hashed byte trigrams at
    length 1, and ratios of words, lines and bytes."""
    import numpy as np

    raw = (text or "").encode("utf-8", "replace")
    low = np.frombuffer(raw.lower(), np.uint8).astype(np.uint32)
    out = np.zeros((1 << BITS) + RATIOS, np.float32)
    words = raw.lower().split()
    if len(low) > 2:
        h = ((low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]) * np.uint32(2654435761) >> np.uint32(32 - BITS)
        grams = np.sqrt(np.bincount(h, minlength=1 << BITS))
        out[: 1 << BITS] = grams / max(1e-9, float(np.sqrt(grams @ grams)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = max(1, len(words))
    ratios = (len(set(words)) / n, 1 - len(set(lines)) / max(1, len(lines)), min(1.0, n / 50), np.log1p(n) / 10, len(raw) / n / 10, (low >= 128).mean() if len(low) else 0.0)
    out[1 << BITS :] = RATIO_WEIGHT * np.array(ratios, np.float32)
    return len(words), out


@dataclass
class Mixer:
    domains: list[str]
    weights: object = None  # by feature and domain; the bias is last
    pulls: list[list[float]] = field(default_factory=list)  # by step: a vector of domains
    wanted: dict[str, float] = field(default_factory=dict)
    reached: dict[str, float] = field(default_factory=dict)

    def fit(self, x, y) -> Mixer:
        """Softmax regression by Adam; ``y`` has the place of each row's domain."""
        import numpy as np

        x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
        goal = np.eye(len(self.domains), dtype=np.float32)[y]
        w = np.zeros((x.shape[1], len(self.domains)), np.float32)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, _EPOCHS + 1):
            z = x @ w
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = x.T @ (p - goal) / len(y) + _L2 * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= _RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights = w
        return self

    def posteriors(self, texts: list[str | None]):
        """Numbers of words, and a row of posteriors for each text."""
        import numpy as np

        n, p = np.zeros(len(texts), np.int64), np.ones((len(texts), len(self.domains)))
        for i, t in enumerate(texts):
            n[i], feats = text_features(t)
            if self.weights is not None:
                z = (feats @ self.weights[:-1] + self.weights[-1]).astype(np.float64)
                p[i] = np.exp(z - z.max())
                p[i] /= p[i].sum()
        return n, p / p.sum(axis=1, keepdims=True) if len(texts) else p

    def rates(self, n, p):
        """The rates after all steps so far, in numpy."""
        import numpy as np

        r = np.ones(len(n))
        for pull in self.pulls:
            r = np.maximum(0.0, r - p @ np.asarray(pull))
        return np.where(n > 0, r, 1.0)

    def rate(self, posterior: Column) -> Column:
        """The same as a Column of an array of posteriors, for documents with words."""

        def step(r: Column, pull: Column) -> Column:
            dot = F.aggregate(F.zip_with(posterior, pull, lambda p, g: p * g), F.lit(0.0), lambda a, x: a + x)
            return F.greatest(F.lit(0.0), r - dot)

        if not self.pulls:
            return F.lit(1.0)
        table = F.array(*[F.array(*[F.lit(float(g)) for g in pull]) for pull in self.pulls])
        return F.aggregate(table, F.lit(1.0), step)


def train_domains(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality") -> Mixer:
    """The classifier, from ``SAMPLE_DOCS`` labelled ids at most."""
    import numpy as np

    known = labelled.where(F.col(label_id).isNotNull() & F.col(label_col).isNotNull())
    picked = known.groupBy(F.col(label_id).alias("label_id")).agg(F.max(F.col(label_col).cast("string")).alias("domain")).orderBy(F.xxhash64("label_id"), "label_id").limit(SAMPLE_DOCS)
    # SAMPLE_DOCS rows of an id and a short label.
    met = docs.join(F.broadcast(picked), F.col(id_col) == F.col("label_id")).select(F.col(id_col).cast("long").alias("id"), "domain", F.col(text_col).alias("text"))

    def run(batches: Iterator):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                # A feature is at most 2 * RATIO_WEIGHT; the ratios of odd texts are cut there.
                rows = [(np.clip(text_features(t)[1], 0, 4) * 16383).astype(np.uint16).tobytes() for t in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.binary())], names=["id", "domain", "x"])

    made = met.mapInArrow(tidied(run), "id long, domain string, x binary")
    rows = made.orderBy(F.xxhash64("id"), "id", "x").limit(SAMPLE_DOCS).collect()
    domains = sorted({r["domain"] for r in rows}) or ["all"]
    if len(domains) == 1:
        return Mixer(domains)
    x = np.array([np.frombuffer(r["x"], np.uint16) for r in rows]).astype(np.float32) / 16383
    return Mixer(domains).fit(x, [domains.index(r["domain"]) for r in rows])


def members(docs: DataFrame, mixer: Mixer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n, posterior): the id, the number of words, and the posteriors in domain order."""
    shipped = docs.sparkSession.sparkContext.broadcast(mixer.weights)  # features x domains: fixed in size

    def run(batches: Iterator):
        import pyarrow as pa

        model = Mixer(mixer.domains, shipped.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                n, p = model.posteriors(b.column(1).to_pylist())
                flat = pa.array(p.ravel())
                lists = pa.ListArray.from_arrays(pa.array(range(0, p.size + 1, p.shape[1]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), lists], names=["doc", "n", "posterior"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidied(run), f"doc {kind}, n long, posterior array<double>")


def fit_rates(rows: DataFrame, mixer: Mixer, targets: dict[str, float], spare: str | None = None) -> Mixer:
    """Fits the rates of ``rows`` (doc, n, posterior); the mixer gets targets and totals in tokens.

    ``targets`` are weights of the domains (those not named share what is left). All targets
    are scaled alike so that ``spare``'s target is what it has, so its documents are not thinned.
    """
    import numpy as np

    k = len(mixer.domains)
    cell = lambda i: F.element_at("posterior", i + 1)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    worded = rows.where("n > 0")

    def gram():
        """Expected totals at the present rates, and the Gram matrix over rates above 0."""
        on = F.when(F.col("rate") > 0, F.col("n")).otherwise(0)
        got = [F.coalesce(F.sum(F.col("rate") * F.col("n") * cell(i)), F.lit(0.0)).alias(f"s{i}") for i in range(k)]
        products = [F.coalesce(F.sum(on * cell(i) * cell(j)), F.lit(0.0)).alias(f"g{i}_{j}") for i, j in pairs]
        row = worded.withColumn("rate", mixer.rate(F.col("posterior"))).agg(*got, *products).first()
        g = np.zeros((k, k))
        for i, j in pairs:
            g[i, j] = g[j, i] = row[f"g{i}_{j}"]
        return np.array([row[f"s{i}"] for i in range(k)]), g

    def totals_after(steps):
        """Expected totals after each one of several next steps, in one pass."""
        dot = lambda d: sum(cell(i) * float(x) for i, x in enumerate(d))
        next_rate = [F.greatest(F.lit(0.0), F.col("rate") - dot(d)) for d in steps]
        got = [F.coalesce(F.sum(r * F.col("n") * cell(i)), F.lit(0.0)).alias(f"s{q}_{i}") for q, r in enumerate(next_rate) for i in range(k)]
        row = worded.withColumn("rate", mixer.rate(F.col("posterior"))).agg(*got).first()
        return np.array([[row[f"s{q}_{i}"] for i in range(k)] for q in range(len(steps))])

    had, whole = gram()
    rest = max(0.0, 1.0 - sum(targets.get(d, 0.0) for d in mixer.domains))
    free = [d for d in mixer.domains if d not in targets]
    share = np.array([targets.get(d, rest / max(1, len(free))) for d in mixer.domains])
    share = share / share.sum() if share.sum() > 0 else np.full(k, 1 / k)
    anchor = mixer.domains.index(spare) if spare in mixer.domains else int(np.argmax(had))
    want = share * (had[anchor] / share[anchor] if share[anchor] > 0 else had.sum())
    named = lambda x: dict(zip(mixer.domains, x.tolist(), strict=True))
    mixer.wanted, mixer.reached = named(want), named(had)
    if k == 1 or had.sum() == 0:
        mixer.wanted = mixer.reached
        return mixer
    solve = lambda g, gap: np.linalg.pinv(g + 1e-9 * max(np.trace(g), 1e-9) * np.eye(k)) @ gap
    got, near = had, whole
    for _ in range(MOST_STEPS):
        gap = got - want
        if np.abs(gap).max() <= TOLERANCE * want.max():
            return mixer
        # Steps by the Gram matrix of the documents still above 0 are the fast ones; those along the
        # gradient get to the optimum where the first ones stall; several lengths are tried at once.
        slope = gap / max(float(np.linalg.eigvalsh(near).max()), 1e-9)
        tries = [solve(near, gap) * t for t in (1.0, 0.5, 0.25)] + [solve(whole, gap)] + [slope * t for t in (0.5, 1.0, 2.0, 8.0, 32.0, 128.0)]
        after = totals_after(tries)
        best = int(np.argmin(np.linalg.norm(after - want, axis=1)))
        if np.linalg.norm(after[best] - want) > np.linalg.norm(gap) * (1 - NEAR):
            return mixer  # the optimum: targets that these documents cannot meet
        mixer.pulls.append(tries[best].tolist())
        got, near = gram()
        mixer.reached = named(got)
    raise RuntimeError(f"rates have not settled after {MOST_STEPS} steps: wanted {mixer.wanted}, reached {mixer.reached}")


#: Target token weights of the registered query and of the pipeline, by the labels' quality: the
#: one column of the labelled table that says which documents a corpus should have more of.
TARGETS, SPARE = {"1": 0.95, "0": 0.05}, "1"


def split_unit(id_col: Column) -> Column:
    return F.pmod(F.xxhash64(id_col, F.lit(SPLIT_SALT)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def copies(rate: Column, id_col: Column) -> Column:
    """Whole copies, and one more where the id's hash is under the fraction."""
    return (F.floor(rate) + (split_unit(id_col) < rate - F.floor(rate)).cast("long")).cast("int")


def _fit(docs: DataFrame, labelled: DataFrame, targets, spare, id_col, text_col, label_id, label_col) -> tuple[Mixer, DataFrame]:
    mixer = train_domains(docs, labelled, id_col, text_col, label_id, label_col)
    rows = cut(members(docs, mixer, id_col, text_col))
    return fit_rates(rows, mixer, targets, spare), rows


def mix(docs: DataFrame, labelled: DataFrame, targets=TARGETS, spare=SPARE, id_col="doc_id", text_col="text", label_id="doc_id", label_col="quality") -> DataFrame:
    """id, n_tokens, domain (the likeliest), posterior (by domain in name order), rate, n_copies."""
    mixer, rows = _fit(docs, labelled, targets, spare, id_col, text_col, label_id, label_col)
    rate = F.when(F.col("n") > 0, mixer.rate(F.col("posterior"))).otherwise(F.lit(1.0))
    best = F.element_at(F.array(*[F.lit(d) for d in mixer.domains]), F.array_position("posterior", F.array_max("posterior")).cast("int"))
    out = rows.withColumn("rate", rate)
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_tokens"), best.alias("domain"), "posterior", "rate", copies(F.col("rate"), F.col("doc")).alias("n_copies"))


def resample(docs: DataFrame, labelled: DataFrame, targets=TARGETS, spare=SPARE, id_col="doc_id", text_col="text", label_id="doc_id", label_col="quality") -> DataFrame:
    """The rows of ``docs`` in as many copies as their rates say, with their columns. Posteriors are
    made again for each text, so texts are written once only."""
    mixer, _ = _fit(docs, labelled, targets, spare, id_col, text_col, label_id, label_col)
    at, width = docs.columns.index(text_col), len(docs.columns)
    shipped = docs.sparkSession.sparkContext.broadcast(mixer.weights)

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        model = Mixer(mixer.domains, shipped.value, mixer.pulls)
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                b = whole.slice(low, 512)
                r = model.rates(*model.posteriors(b.column(at).to_pylist()))
                unit = np.asarray(b.column(width).to_pylist(), float)
                n = (np.floor(r) + (unit < r - np.floor(r))).astype(np.int64)
                yield b.select(range(width)).take(pa.array(np.repeat(np.arange(b.num_rows), n)))

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema])
    return docs.withColumn("mix_unit_", split_unit(F.col(id_col))).mapInArrow(tidied(run), schema)
