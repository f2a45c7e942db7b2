"""A hashed maximum-entropy language model with a class-factored softmax.

A word's probability is p(class | context) * p(leaf | class, context) * p(word | leaf). A word's class comes from its last two
bytes. The most frequent words of a class have leaves of their own; the others share leaves by their endings, where they
are told apart by their counts.

* Classes: log-linear in two sparse features, the previous word (n-gram) and the word before it (skip). Every word of the training
  texts has its own row of weights for both, so this evidence grows with the corpus. Rows live in buckets of the hash
  space, which bring together the counts of all blocks and take a scaled step along the likelihood's gradient
  from the model without contexts: ln(share / expected share) / 2, there being two features. A block is sent the rows of
  its own words only.
* Leaves: log-linear in hashed features (previous word, two previous words, skip). Blocks run gradient updates on their own documents
  and send the change of the weights by slices; slices are summed in two levels and averaged between rounds.

Blocks depend on ids and the amount of text alone, and sums have a fixed order, so scores do not depend on the cluster.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushpage.llm.blocks import cut, drop_unused
from hushpage.llm.keysets import bucket_edges, decode_sorted, encode_sorted, in_order, text_block_count, text_blocks
from hushpage.llm.textblocks import as_bytes, mix, word_hashes_and_endings

WIDTH = 32  # classes, and leaves of a class
OWN = WIDTH // 2  # leaves of single words in each class; as many are shared by endings
LEAVES = WIDTH * WIDTH
END, START = np.uint64(0xA5A5A5A5DEADBEEF), np.uint64(0x5EED5EED5EED5EED)
ROWS = 1 << 14  # hashed feature rows of the leaves' softmax; the first WIDTH are biases
SLICES = 16
SMOOTH = 4.0  # tokens of the classes' overall shares that each row of class weights is mixed with


class Tokens:
    """Token arrays of a batch of texts: hashes with an end after each text, classes, shared leaves."""

    def __init__(self, texts: list[bytes]):
        words, off, ending = word_hashes_and_endings([t.lower() for t in texts])
        self.hash = np.insert(words, off[1:], END)
        self.off = off + np.arange(len(off))
        classes = mix((ending & np.uint32(0xFFFF)).astype(np.uint64)) % np.uint64(WIDTH)
        inner = mix(ending.astype(np.uint64) + np.uint64(1 << 40)) % np.uint64(WIDTH - OWN)
        shared = (classes * np.uint64(WIDTH) + inner).astype(np.int32) + OWN
        self.shared = np.insert(shared, off[1:], OWN)
        self.classes = self.shared // WIDTH

    def shifted(self, values: np.ndarray, start) -> np.ndarray:
        """The value of the token before each token of the same text; ``start`` before the first."""
        out = np.concatenate((values[:1], values[:-1]))
        out[self.off[:-1]] = start
        return out

    def features(self) -> list[np.ndarray]:
        before = self.shifted(self.hash, START)
        second = self.shifted(before, START)
        return [mix(before), mix(before * np.uint64(3) + second), mix(second + np.uint64(0x1234567))]

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ascending distinct hashes with the start's, a token's first place by hash, each token's place among the hashes)."""
        found, first, back = np.unique(np.append(self.hash, START), return_index=True, return_inverse=True)
        return found, first, back[:-1]

    def leaves(self, frequent: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Leaf of each token: its own if it is among the ``frequent`` hashes (ascending), else that of its ending."""
        if not len(frequent):
            return self.shared
        at = np.minimum(np.searchsorted(frequent, self.hash), len(frequent) - 1)
        return np.where(frequent[at] == self.hash, place[at], self.shared)


class LeafModel:
    """Weights of p(leaf | class, context), one row of WIDTH a hashed feature."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    @classmethod
    def start(cls, leaf_counts: np.ndarray) -> LeafModel:
        """Weights that give each leaf its smoothed share of its class's training tokens whatever the context."""
        share = (leaf_counts + 0.5).reshape(WIDTH, WIDTH)
        weights = np.zeros((ROWS, WIDTH), dtype=np.float32)
        weights[:WIDTH] = np.log(share / share.sum(axis=1, keepdims=True))
        return cls(weights)

    @staticmethod
    def rows(features: list[np.ndarray], classes: np.ndarray) -> np.ndarray:
        """The class's bias row and the hashed rows of its features, one line a feature."""
        salt = classes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        hashed = [((mix(f + salt) >> np.uint64(20)) % np.uint64(ROWS - WIDTH) + np.uint64(WIDTH)).astype(np.uint16) for f in features]
        return np.stack([classes.astype(np.uint16), *hashed])

    def shares(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp(logits) of each token's leaves, and their sums."""
        logits = self.weights[rows[0]]
        for r in rows[1:]:
            logits += self.weights[r]
        np.minimum(logits, 60.0, out=logits)  # far from where sums of floats overflow
        np.exp(logits, out=logits)
        return logits, logits @ np.ones(WIDTH, dtype=np.float32)

    def log(self, rows: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """ln p(leaf | class, context) of each token."""
        top, total = self.shares(rows)
        return np.log(np.maximum(top[np.arange(len(inner)), inner] / total, 1e-30))

    def update(self, rows: np.ndarray, inner: np.ndarray, seen: np.ndarray, rate: float) -> None:
        """One gradient step over a batch, each row's step scaled by its past gradients (``seen``)."""
        gap, total = self.shares(rows)
        gap /= total[:, None]
        gap[np.arange(len(inner)), inner] -= 1.0
        flat = rows.ravel()
        order = np.argsort(flat, kind="stable")  # 16-bit keys, so numpy sorts by radix
        ranked = flat[order]
        first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        sums = np.add.reduceat(gap[order % len(inner)], first, axis=0)
        touched = ranked[first]
        seen[touched] += np.einsum("ij,ij->i", sums, sums)
        self.weights[touched] -= rate * sums / np.sqrt(seen[touched] + 1.0)[:, None]


# ---- rows of class counts and weights, sparse --------------------------------------------------------


def pack_small(values: np.ndarray) -> bytes:
    """Counts in a byte each, and those of 255 or more once again in eight."""
    return np.minimum(values, 255).astype(np.uint8).tobytes() + values[values >= 255].astype("<u8").tobytes()


def unpack_small(blob: bytes, n: int) -> np.ndarray:
    values = np.frombuffer(blob, dtype=np.uint8, count=n).astype(np.int64)
    values[values == 255] = np.frombuffer(blob, dtype="<u8", offset=n)
    return values


def pack_counts(counts: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """Counts (one line a word, one column a class) as a blob for each range of words: how many classes each word
    has, the classes, and their counts."""
    word, kind = np.nonzero(counts)
    values = counts[word, kind]
    many = np.bincount(word, minlength=len(counts)).astype(np.uint8)
    at, kind = np.searchsorted(word, edges), kind.astype(np.uint8)
    return [
        many[a:b].tobytes() + kind[i:j].tobytes() + pack_small(values[i:j]) for a, b, i, j in zip(edges[:-1], edges[1:], at[:-1], at[1:], strict=True)
    ]


def unpack_counts(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes of each of n words, the classes, the counts) of a blob of pack_counts."""
    raw = np.frombuffer(blob, dtype=np.uint8)
    many = raw[:n]
    size = int(many.sum(dtype=np.int64))
    return many, raw[n : n + size], unpack_small(blob[n + size :], size)


class ClassRows:
    """Shares of the classes that follow each word: those of at least two tokens and an eighth (four times an even share)."""

    def __init__(self, word: np.ndarray, kind: np.ndarray, n: np.ndarray, words: int):
        cell, back = np.unique(word * WIDTH + kind, return_inverse=True)
        sums = np.bincount(back, weights=n, minlength=len(cell))
        total = np.bincount(cell // WIDTH, weights=sums, minlength=words)
        kept = (sums >= 2) & (8 * sums >= total[cell // WIDTH])
        cell = cell[kept]
        self.kind = (cell % WIDTH).astype(np.uint8)
        self.share = np.round(-32 * np.log2(sums[kept] / total[cell // WIDTH])).astype(np.uint8)
        self.many = np.bincount(cell // WIDTH, minlength=words).astype(np.uint8)
        self.first = np.concatenate(([0], np.cumsum(self.many, dtype=np.int64)))

    def blob(self, words: np.ndarray) -> bytes:
        """The rows of these words: how many classes each has, the classes, and -32 log2 of their shares."""
        many = self.many[words]
        ends = np.cumsum(many, dtype=np.int64)
        at = np.repeat(self.first[words] - (ends - many), many) + np.arange(int(many.sum(dtype=np.int64)))
        return many.tobytes() + self.kind[at].tobytes() + self.share[at].tobytes()


def class_factors(blobs: list[bytes], sizes: np.ndarray, counts: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """exp(weights) of the class rows of a block's words, one line a word; 1 where a class has no weight."""
    out = np.ones((int(sizes.sum()), WIDTH), dtype=np.float32)
    start = 0
    for blob, n in zip(blobs, sizes.tolist(), strict=True):
        raw = np.frombuffer(blob, dtype=np.uint8)
        many = raw[:n]
        size = (len(raw) - n) // 2
        word = start + np.repeat(np.arange(n), many)
        kind = raw[n : n + size]
        seen = counts[word].astype(np.float64)
        share = (np.exp2(raw[n + size :] / -32.0) * seen + SMOOTH * prior[kind]) / (seen + SMOOTH)
        out[word, kind] = np.sqrt(share / prior[kind])
        start += n
    return out


def log_classes(prior: np.ndarray, one: np.ndarray, two: np.ndarray, before: np.ndarray, second: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """ln p(class | context) of tokens: ``one`` and ``two`` have the factors by previous word and by the word before it."""
    product = one[before] * two[second]
    top = product[np.arange(len(classes)), classes] * prior[classes]
    return np.log(np.maximum(top / (product @ prior.astype(np.float32)), 1e-30))


# ---- training and scoring ----------------------------------------------------------------------------

_KIND = np.dtype([("n", "<u4"), ("leaf", "<u2")])
_SENT = "block int, bucket int, keys binary, counts binary, after binary, skip binary"


def _average(rows: pa.Table, order: str, dtype: str) -> tuple[np.ndarray, int]:
    """The sum of changes in a fixed order, each times its tokens, and the tokens."""
    total, weight = None, 0
    for i in np.argsort(rows[order].to_numpy()).tolist():
        part = np.frombuffer(rows["change"][i].as_py(), dtype=dtype).astype(np.float64)
        n = rows["tokens"][i].as_py()
        part = part * n if dtype == "<f2" else part
        total, weight = part if total is None else total + part, weight + n
    return total, weight


def train(base: DataFrame, n: int, model: LeafModel, frequent: np.ndarray, place: np.ndarray, rounds: int, rate: float, batch: int = 2_048) -> LeafModel:
    """One pass over all training texts in ``rounds`` rounds; round r takes the blocks whose number modulo ``rounds`` is r.

    A round's blocks start from the same weights. Their changes meet slice by slice, in groups of about the square root of
    the blocks first, so that no task gathers all of them.
    """
    spark = base.sparkSession
    size = model.weights.size
    edges = np.linspace(0, size, SLICES + 1).astype(int)
    groups = max(1, math.isqrt(n // max(rounds, 1)))

    def learner(sent):
        def learn(rows: pa.Table) -> pa.Table:
            start, known, leaf = sent.value
            local, seen, done = LeafModel(start.copy()), np.zeros(ROWS, dtype=np.float32), 0
            texts = as_bytes(rows.take(pc.sort_indices(rows["turn"]))["text"].to_pylist())
            for at in range(0, len(texts), 512):
                tokens = Tokens(texts[at : at + 512])
                leaves = tokens.leaves(known, leaf)
                lines, inner = LeafModel.rows(tokens.features(), tokens.classes), leaves % WIDTH
                for i in range(0, len(inner), batch):
                    local.update(lines[:, i : i + batch], inner[i : i + batch], seen, rate)
                done += len(inner)
            change = (local.weights - start).ravel().astype("<f2")
            block = rows["block"][0].as_py()
            return pa.table(
                {
                    "slice": pa.array(range(SLICES), pa.int32()),
                    "grp": pa.array([block // rounds % groups] * SLICES, pa.int32()),
                    "block": pa.array([block] * SLICES, pa.int32()),
                    "tokens": pa.array([done] * SLICES, pa.int64()),
                    "change": pa.array([change[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
                }
            )

        return learn

    for r in range(min(rounds, n)):
        sent = spark.sparkContext.broadcast((model.weights, frequent, place))  # ROWS * WIDTH floats and at most LEAVES words

        def some(rows: pa.Table) -> pa.Table:
            total, weight = _average(rows, "block", "<f2")
            return pa.table({"slice": rows["slice"][:1], "grp": rows["grp"][:1], "tokens": pa.array([weight], pa.int64()), "change": pa.array([total.astype("<f8").tobytes()], pa.binary())})

        def every(rows: pa.Table) -> pa.Table:
            total, weight = _average(rows, "grp", "<f8")
            return pa.table({"slice": rows["slice"][:1], "change": pa.array([(total / max(weight, 1)).astype("<f4").tobytes()], pa.binary())})

        own = base.where((F.col("block") % rounds == r) & ~F.col("held"))
        changes = own.groupBy("block").applyInArrow(learner(sent), "slice int, grp int, block int, tokens long, change binary")
        changes = changes.groupBy("slice", "grp").applyInArrow(some, "slice int, grp int, tokens long, change binary")
        flat = model.weights.ravel().copy()
        for row in changes.groupBy("slice").applyInArrow(every, "slice int, change binary").collect():
            flat[edges[row.slice] : edges[row.slice + 1]] += np.frombuffer(row.change, dtype="<f4")
        model = LeafModel(flat.reshape(-1, WIDTH))
        sent.unpersist()
        del own, changes
        drop_unused(spark)
    return model


def language_model_scores(docs: DataFrame, held_out: Column, rounds: int = 4, rate: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    The model learns from rows that are not held out. Tokens are the words with A-Z lower-cased, then an end. base_score adds
    log10((c + 0.5) / (N + 0.5 (V + 1))) over the tokens; score is the model's log10 probability, in which unknown words of a
    leaf count as one more word of it. A null or empty text is its end. Null ids and repeated rows are scored as they
    are; rows are dealt by id and text, so many null ids fill no block. Without training rows N is 0 and the model is uniform over classes and leaves. An
    empty table gives no rows. Only the named columns and those of the expression are read.
    """
    n = text_block_count(docs, text_col, spread=False)
    flags = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    flags = flags.withColumn("turn", F.xxhash64("id", "text"))  # deals rows to blocks, and orders them inside
    base = text_blocks(flags, F.pmod("turn", F.lit(n)).cast("int"), n, ["id", "text", "held", "turn"])

    def send(rows: pa.Table) -> pa.Table:
        tokens = Tokens(as_bytes(rows["text"].to_pylist()))
        learnt = np.repeat(~rows["held"].to_numpy(), np.diff(tokens.off))
        keys, first, back = tokens.keys()
        counts = np.zeros(len(keys), dtype=_KIND)
        counts["n"] = np.bincount(back[learnt], minlength=len(keys))
        counts["leaf"] = np.append(tokens.shared, 0)[first]
        edges = bucket_edges(keys, n, 64)
        blobs, place = [], np.searchsorted(keys, START)
        before = tokens.shifted(back, place)
        for at in (before, tokens.shifted(before, place)):
            cells = np.bincount(at[learnt] * WIDTH + tokens.classes[learnt], minlength=len(keys) * WIDTH)
            blobs.append(pack_counts(cells.reshape(-1, WIDTH), edges))
        spans = list(zip(edges[:-1], edges[1:], strict=True))
        return pa.table(
            {
                "block": pa.array([rows["block"][0].as_py()] * n, pa.int32()),
                "bucket": pa.array(range(n), pa.int32()),
                "keys": pa.array([encode_sorted(keys[a:b]) for a, b in spans], pa.binary()),
                "counts": pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary()),
                "after": pa.array(blobs[0], pa.binary()),
                "skip": pa.array(blobs[1], pa.binary()),
            }
        ).filter(pa.array(np.diff(edges) > 0))

    top_type = pa.list_(pa.struct([("hash", pa.int64()), ("n", pa.int64()), ("leaf", pa.int32())]))
    answer_schema = "block int, bucket int, answer binary, after binary, skip binary, leaf_n array<long>, leaf_v array<long>, top array<struct<hash: long, n: long, leaf: int>>"

    def judge(rows: pa.Table) -> pa.Table:
        keys = [decode_sorted(b) for b in rows["keys"].to_pylist()]
        counts = np.concatenate([np.frombuffer(b, _KIND) for b in rows["counts"].to_pylist()])
        found, first, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        total = np.bincount(back, weights=counts["n"], minlength=len(found)).astype("<u8")
        leaf = counts["leaf"][first].astype(np.int64)
        per = np.split(back, np.cumsum([len(x) for x in keys])[:-1])
        answers = [[pack_small(total[x]) for x in per]]
        for family in ("after", "skip"):
            word, kind, values = [], [], []
            for x, blob in zip(per, rows[family].to_pylist(), strict=True):
                many, kinds, sums = unpack_counts(blob, len(x))
                word.append(np.repeat(x, many))
                kind.append(kinds)
                values.append(sums)
            table = ClassRows(np.concatenate(word), np.concatenate(kind), np.concatenate(values), len(found))
            answers.append([table.blob(x) for x in per])
        order = np.lexsort((found, -total.astype(np.int64), leaf // WIDTH))
        order = order[total[order] > 0]
        kinds = leaf[order] // WIDTH
        best = order[np.arange(len(order)) - np.searchsorted(kinds, kinds) < OWN]  # of each class the most frequent
        m, none = rows.num_rows, [None] * rows.num_rows
        return pa.table(
            {
                "block": pa.array([*rows["block"].to_pylist(), -1], pa.int32()),
                "bucket": pa.array([*rows["bucket"].to_pylist(), -1], pa.int32()),
                **{k: pa.array([*v, None], pa.binary()) for k, v in zip(("answer", "after", "skip"), answers, strict=True)},
                "leaf_n": pa.array([*none, np.bincount(leaf, weights=total, minlength=LEAVES).astype(np.int64).tolist()], pa.list_(pa.int64())),
                "leaf_v": pa.array([*none, np.bincount(leaf, weights=total > 0, minlength=LEAVES).astype(np.int64).tolist()], pa.list_(pa.int64())),
                "top": pa.array([*[None] * m, [{"hash": int(h), "n": int(c), "leaf": int(x)} for h, c, x in zip(found[best].view(np.int64), total[best], leaf[best], strict=True)]], top_type),
            }
        )

    sent = base.groupBy("block").applyInArrow(send, _SENT)
    judged = cut(sent.groupBy("bucket").applyInArrow(judge, answer_schema))
    drop_unused(docs.sparkSession, judged)
    sums = judged.where("block = -1").select(F.posexplode(F.arrays_zip("leaf_n", "leaf_v")).alias("leaf", "x"))
    sums = sums.groupBy("leaf").agg(F.sum("x.leaf_n").alias("n"), F.sum("x.leaf_v").alias("v")).collect()  # one row a leaf
    leaf_n, leaf_v = np.zeros(LEAVES), np.zeros(LEAVES)
    for row in sums:
        leaf_n[row.leaf], leaf_v[row.leaf] = row.n, row.v
    big_n, big_v = int(leaf_n.sum()), int(leaf_v.sum())
    by_class = Window.partitionBy("kind").orderBy(F.desc("n"), "hash")
    tops = judged.where("block = -1").select(F.explode("top").alias("t")).select("t.*").withColumn("kind", F.floor(F.col("leaf") / WIDTH))
    tops = tops.withColumn("r", F.row_number().over(by_class)).where(F.col("r") <= OWN).collect()  # at most LEAVES / 2 rows
    for t in tops:
        own = int(t.kind) * WIDTH + t.r - 1
        leaf_n[own], leaf_v[own] = t.n, 1
        leaf_n[t.leaf] -= t.n
        leaf_v[t.leaf] -= 1
    names = np.asarray([t.hash for t in tops], dtype=np.int64).view(np.uint64)
    order = np.argsort(names)
    frequent, place = names[order], np.asarray([int(t.kind) * WIDTH + t.r - 1 for t in tops], dtype=np.int32)[order]
    model = LeafModel.start(leaf_n)
    if big_n:
        model = train(base, n, model, frequent, place, rounds, rate)
    prior = leaf_n.reshape(WIDTH, WIDTH).sum(axis=1) + 0.5
    shared = np.arange(LEAVES) % WIDTH >= OWN
    rest = np.where(shared, np.log(leaf_n + 0.5 * (leaf_v + 1)), 0.0)
    ready = docs.sparkSession.sparkContext.broadcast((model.weights, frequent, place, prior / prior.sum(), rest, shared))
    base_rest = np.log10(big_n + 0.5 * (big_v + 1))

    def finish(rows: pa.Table, answer: pa.Table) -> pa.Table:
        weights, known, leaf_of, share, in_leaf, is_shared = ready.value
        scorer, tokens = LeafModel(weights), Tokens(as_bytes(rows["text"].to_pylist()))
        keys, _, back = tokens.keys()
        edges = bucket_edges(keys, n, 64)
        sizes = np.diff(edges)[np.diff(edges) > 0]
        counts = np.concatenate([unpack_small(b, s) for b, s in zip(in_order(answer), sizes.tolist(), strict=True)])
        assert len(counts) == len(keys)
        one, two = (class_factors(in_order(answer, c), sizes, counts, share) for c in ("after", "skip"))
        place_of_start = np.searchsorted(keys, START)
        before = tokens.shifted(back, place_of_start)
        second = tokens.shifted(before, place_of_start)
        leaves, features = tokens.leaves(known, leaf_of), tokens.features()
        log_p = np.zeros(len(back))
        for a in range(0, len(back), 8_192):
            part = slice(a, a + 8_192)
            lines = LeafModel.rows([f[part] for f in features], tokens.classes[part])
            log_p[part] = log_classes(share, one, two, before[part], second[part], tokens.classes[part])
            log_p[part] += scorer.log(lines, leaves[part] % WIDTH)
        c = counts[back].astype(np.float64)
        seen = np.log(c + 0.5)
        log_p += np.where(is_shared[leaves], seen - in_leaf[leaves], 0.0)
        a = tokens.off[:-1]
        return pa.table(
            {
                id_col: rows["id"],
                "held_out": rows["held"],
                "n_tokens": pa.array(np.diff(tokens.off)),
                "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), a)),
                "train_tokens": pa.array(np.full(len(a), big_n, dtype=np.int64)),
                "base_score": pa.array(np.add.reduceat(np.log10(c + 0.5) - base_rest, a)),
                "score": pa.array(np.add.reduceat(log_p, a) / np.log(10)),
            }
        )

    replies = judged.where("block >= 0").select("block", "bucket", "answer", "after", "skip")
    kind_of_id = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind_of_id}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return base.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, schema)

