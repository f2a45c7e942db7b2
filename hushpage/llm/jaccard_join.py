"""Near-duplicate documents by a prefix-tree join on sets of word shingles.

Shingles are ordered globally, rarest first. Two sets of Jaccard similarity t or more share a shingle
among the first n - ceil(t n) + 1 of each, and their places there bound what they can share. Sets that meet so are
compared in prefix trees: the sets that meet one set share the overlaps of their common beginnings, and a
subtree is left as soon as what remains of it cannot reach the threshold.

Equal sets form classes first. Then each class meets, for each of its prefix shingles, the least
and the greatest class that has it, which settles dense groups with a few comparisons a class; classes
that meet and are still in different components are compared in a second round, so no link is lost. There a shingle
of many components makes no pairs: its classes go to prefix trees of a bounded size, which the others search.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushpage.llm.blocks import cut, drop_unused
from hushpage.llm.components import connected_components
from hushpage.llm.keysets import ANSWERS, BLOBS, answers, bucket_edges, decode_sorted, in_order, key_blobs, text_block_count, text_blocks
from hushpage.llm.textblocks import as_bytes, gram_hashes, mix, tidy, tidy_pair, word_hashes


#: Up to this number, ids of removed rows are sent to the tables they belong to (at most some 50 MB); beyond it both sides are
#: shuffled by id. Results are the same.
BROADCAST_IDS = 2_000_000
#: Sets that one prefix tree holds, and pairs that one shingle may make in the second round; beyond them trees are searched instead.
TREE_SETS, TOKEN_PAIRS = 256, 1 << 16


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Ascending distinct hashes of the k-word shingles of each lower-cased text; fewer words form one shingle."""
    words, off = word_hashes([t.lower() for t in texts])
    grams = gram_hashes(words, k)
    out = []
    for a, b in zip(off[:-1], off[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(mix(gram_hashes(words[a:b], int(b - a)) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


class PrefixTree:
    """Path-compressed trie of token sequences in a global order, for overlap search."""

    class _Node:
        __slots__ = ("children", "ends", "least", "most", "segment")

        def __init__(self, segment: np.ndarray):
            self.segment, self.children, self.ends = segment, {}, []
            self.least, self.most = 1 << 62, 0  # sizes of sets below; tokens below this node's segment

    def __init__(self, percent: int):
        self.percent, self.root = percent, self._Node(np.zeros(0, dtype=np.uint64))

    def insert(self, name: int, size: int, tokens: np.ndarray) -> None:
        node, at = self.root, 0
        while True:
            node.least, node.most = min(node.least, size), max(node.most, len(tokens) - at)
            if at == len(tokens):
                node.ends.append((name, size))
                return
            child = node.children.get(tokens[at])
            if child is None:
                child = node.children[tokens[at]] = self._Node(tokens[at:])
                child.least = size
                child.ends.append((name, size))
                return
            shared = min(len(child.segment), len(tokens) - at)
            differ = np.flatnonzero(child.segment[:shared] != tokens[at : at + shared])
            shared = int(differ[0]) if len(differ) else shared
            if shared < len(child.segment):
                upper = self._Node(child.segment[:shared])
                upper.least, upper.most = child.least, child.most + len(child.segment) - shared
                child.segment = child.segment[shared:]
                upper.children[child.segment[0]] = child
                node.children[tokens[at]] = child = upper
            node, at = child, at + shared

    def search(self, size: int, tokens: np.ndarray) -> list[int]:
        """Names of the sets whose similarity with this set is at least the threshold."""
        order = np.argsort(tokens)
        ranked = tokens[order]
        out: list[int] = []
        stack = [(self.root, 0, 0)]  # node, overlap so far, tokens of the query passed
        while stack:
            node, overlap, passed = stack.pop()
            if len(node.segment) and len(ranked):
                at = np.minimum(np.searchsorted(ranked, node.segment), len(ranked) - 1)
                hit = ranked[at] == node.segment
                if hit.any():
                    overlap += int(hit.sum())
                    passed = int(order[at[hit]].max()) + 1
            for name, other in node.ends:
                if overlap * (100 + self.percent) >= self.percent * (size + other):
                    out.append(name)
            for child in node.children.values():
                reach = overlap + min(len(child.segment) + child.most, len(tokens) - passed)
                if reach * (100 + self.percent) >= self.percent * (size + child.least):
                    stack.append((child, overlap, passed))
        return out


def _documents(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, h1, h2, tokens): size and 128-bit hash of each set; tokens, in global order, only where at least
    ``percent`` of the set occur in another document too. Other sets are linked with nothing."""
    n = text_block_count(docs, text_col)
    rows = docs.count()
    bits = min(64, max(32, math.ceil(math.log2(rows + 1)) + 14))  # about one in 30 keys collides; only the order sees it
    shift = np.uint64(64 - bits)
    columns = [F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")]
    base = text_blocks(docs, F.pmod(F.xxhash64(id_col, text_col), F.lit(n)).cast("int"), n, columns)

    def sets_of(rows: pa.Table) -> list[np.ndarray]:
        return shingle_sets(as_bytes(rows["text"].to_pylist()), k)

    def send(rows: pa.Table) -> pa.Table:
        keys = np.concatenate(sets_of(rows)) >> shift
        found, counts = np.unique(keys, return_counts=True)
        return key_blobs(rows["block"][0].as_py(), found, np.minimum(counts, 255).astype(np.uint8), n, bits)

    def judge(rows: pa.Table) -> pa.Table:
        keys = [decode_sorted(b) for b in rows["keys"].to_pylist()]
        counts = np.concatenate([np.frombuffer(b, np.uint8) for b in rows["counts"].to_pylist()]).astype(np.float64)
        _, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.minimum(np.bincount(back, weights=counts), 255).astype(np.uint8)[back] if len(back) else counts.astype(np.uint8)
        return answers(rows, [x.tobytes() for x in np.split(total, np.cumsum([len(x) for x in keys])[:-1])])

    def finish(rows: pa.Table, answer: pa.Table) -> pa.Table:
        sets = sets_of(rows)
        every = np.concatenate(sets)
        found, back = np.unique(every >> shift, return_inverse=True)
        held = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(b, np.uint8) for b in in_order(answer))])  # 255 stands for more
        assert len(held) == len(found) == bucket_edges(found, n, bits)[-1]
        often = held[back]
        ends = np.cumsum([len(s) for s in sets])
        h1, h2, tokens = [], [], []
        for s, df in zip(sets, np.split(often, ends[:-1]), strict=True):
            h1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
            h2.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
            shared = df > 1
            if len(s) and 100 * int(shared.sum()) >= percent * len(s):
                tokens.append(s[shared][np.lexsort((s[shared], df[shared]))].astype("<u8").tobytes())
            else:
                tokens.append(None)
        return pa.table(
            {
                "id": rows["id"],
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "h1": pa.array(h1, pa.int64()),
                "h2": pa.array(h2, pa.int64()),
                "tokens": pa.array(tokens, pa.binary()),
            }
        )

    sent = base.groupBy("block").applyInArrow(tidy(send), BLOBS)
    judged = sent.groupBy("bucket").applyInArrow(tidy(judge), ANSWERS)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n long, h1 long, h2 long, tokens binary"
    return base.groupBy("block").cogroup(judged.groupBy("block")).applyInArrow(tidy_pair(finish), schema)


def _postings(classes: DataFrame, percent: int, kind: str) -> DataFrame:
    """(token, cid, n, pos): the shared shingles in each class's prefix, with their place in the global order."""

    def explode(batches):
        for batch in batches:
            token, cid, size, pos = [], [], [], []
            for c, n, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                all_tokens = np.frombuffer(raw, "<i8")
                rare = n - len(all_tokens)  # shingles of no other document come first in the order
                take = max(min(prefix_length(n, percent) - rare, len(all_tokens)), 0)
                token.append(all_tokens[:take])
                cid += [c] * take
                size.append(np.full(take, n, dtype=np.int64))
                pos.append(np.arange(rare, rare + take, dtype=np.int64))
            if cid:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(token)), pa.array(cid, batch.schema.field(0).type), pa.array(np.concatenate(size)), pa.array(np.concatenate(pos))],
                    names=["token", "cid", "n", "pos"],
                )

    return classes.select("cid", "n", "tokens").mapInArrow(explode, f"token long, cid {kind}, n long, pos long")


def _may_reach(a: str, b: str, percent: int) -> Column:
    """Whether sets that meet at places pos can reach the threshold: they share that shingle and later ones at most."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    reach = F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos"))
    return reach * (100 + percent) >= percent * (n + m)


def _parts(classes_of_token: Column) -> Column:
    """Prefix trees that the classes of one shingle are dealt to."""
    return F.ceil(classes_of_token / TREE_SETS).cast("int")


def _verify(pairs: DataFrame, classes: DataFrame, percent: int, kind: str) -> DataFrame:
    """Links (a, b) among candidate pairs (lead, cid, parts), by prefix trees.

    A lead's candidates go to ``parts`` trees by their hash. How many comes from the shingle by which they met, so a lead of a
    large group has many trees, and none of them needs to know how many candidates the lead has.
    """
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    sets = classes.select("cid", "n", "tokens")
    members = dealt.select("lead", "parts", "part", "cid").join(sets, "cid")
    asked = dealt.select(F.col("lead").alias("l"), F.col("parts").alias("of"), F.col("part").alias("p")).distinct()
    leads = asked.join(sets.toDF("l", "l_n", "l_tokens"), "l")

    def compare(lead: pa.Table, member: pa.Table) -> pa.Table:
        a, b = [], []
        if lead.num_rows and member.num_rows:
            names = member["cid"].to_pylist()
            found = _tree(member, percent).search(lead["l_n"][0].as_py(), np.frombuffer(lead["l_tokens"][0].as_py(), "<u8"))
            b = [names[i] for i in found]
            a = [lead["l"][0].as_py()] * len(b)
        return pa.table({"a": pa.array(a, lead.schema.field("l").type), "b": pa.array(b, lead.schema.field("l").type)})

    return leads.groupBy("l", "of", "p").cogroup(members.groupBy("lead", "parts", "part")).applyInArrow(compare, f"a {kind}, b {kind}")


def _tree(members: pa.Table, percent: int) -> PrefixTree:
    tree = PrefixTree(percent)
    for i, (n, raw) in enumerate(zip(members["n"].to_pylist(), members["tokens"].to_pylist(), strict=True)):
        tree.insert(i, n, np.frombuffer(raw, "<u8"))
    return tree


def _tree_join(hot: DataFrame, classes: DataFrame, percent: int, kind: str) -> DataFrame:
    """Links (a, b) between classes of different components that share a shingle of many components.

    hot: token, cid, comp, main, parts. The classes of a token are dealt to prefix trees; each class outside the token's main
    component searches all of them. Only links leave a task.
    """
    sets = classes.select("cid", "n", "tokens")
    members = hot.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")).select("token", "part", "cid", "comp").join(sets, "cid")
    asking = hot.where("comp <> main").select("token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "cid", "comp").join(sets, "cid")
    asking = asking.select("token", "part", "cid", "comp", "n", "tokens").toDF("at", "of", "q_cid", "q_comp", "q_n", "q_tokens")

    def search(held: pa.Table, queries: pa.Table) -> pa.Table:
        a, b = [], []
        if held.num_rows and queries.num_rows:
            tree, names, comps = _tree(held, percent), held["cid"].to_pylist(), held["comp"].to_pylist()
            for cid, comp, n, raw in zip(*(queries[c].to_pylist() for c in ("q_cid", "q_comp", "q_n", "q_tokens")), strict=True):
                found = [names[i] for i in tree.search(n, np.frombuffer(raw, "<u8")) if comps[i] != comp]
                b += found
                a += [cid] * len(found)
        return pa.table({"a": pa.array(a, held.schema.field("cid").type), "b": pa.array(b, held.schema.field("cid").type)})

    return members.groupBy("token", "part").cogroup(asking.groupBy("at", "of")).applyInArrow(search, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row: the size of its set and the least id reachable by links.

    Two rows link when 100 * intersection >= percent * union of their sets. A null text or one without words has an
    empty set and no links. Repeated rows are linked by their equal sets. A row with a null id is
    returned with a null component and takes no part in links. An empty table gives no rows. Only the two
    named columns are read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sets = cut(_documents(docs, k, percent, id_col, text_col))
    drop_unused(docs.sparkSession, sets)  # texts were shuffled for it
    usable = sets.where("tokens IS NOT NULL AND id IS NOT NULL")
    classes = cut(usable.groupBy("h1", "h2", "n").agg(F.min("id").alias("cid"), F.first("tokens").alias("tokens")))
    postings = _postings(classes, percent, kind)  # cheaper to derive again from the classes than to keep
    ends = postings.groupBy("token").agg(F.min("cid").alias("low"), F.max("cid").alias("high"), _parts(F.count(F.lit(1))).alias("parts")).where("low <> high")
    met = postings.select("token", "cid").join(ends, "token").select("cid", F.explode(F.array("low", "high")).alias("lead"), "parts")
    first = cut(met.where("cid <> lead").groupBy("lead", "cid").agg(F.max("parts").alias("parts")))
    links = cut(_verify(first, classes, percent, kind))
    found = connected_components(links)
    labels = postings.select("token", "cid", "n", "pos").join(found.withColumnRenamed("node", "cid"), "cid", "left")
    labels = labels.select("token", "cid", "n", "pos", F.coalesce("component", "cid").alias("comp"))
    per = labels.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("m"))
    main = per.groupBy("token").agg(F.max(F.struct("m", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"), F.sum("m").alias("all"))
    main = main.where("comps > 1").select("token", F.col("main.comp").alias("main"), "all", ((F.col("all") - F.col("main.m")) * F.col("all")).alias("most_pairs"))
    labels = cut(labels.join(main, "token").withColumn("parts", _parts(F.col("all"))))
    few = labels.where(F.col("most_pairs") <= TOKEN_PAIRS)
    rest, every = few.where("comp <> main").alias("x"), few.alias("y")
    apart = (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp"))
    once = (F.col("y.comp") == F.col("y.main")) | (F.col("x.cid") < F.col("y.cid"))
    again = rest.join(every, apart & once & _may_reach("x", "y", percent))
    again = again.groupBy(F.col("x.cid").alias("lead"), F.col("y.cid").alias("cid")).agg(F.max("x.parts").alias("parts"))
    tried = first.select("lead", "cid").union(first.select(F.col("cid").alias("lead"), F.col("lead").alias("cid")))
    again = cut(again.join(tried, ["lead", "cid"], "left_anti"))
    hot = labels.where(F.col("most_pairs") > TOKEN_PAIRS).select("token", "cid", "comp", "main", "parts")
    more = cut(_verify(again, classes, percent, kind).union(_tree_join(hot, classes, percent, kind)))
    final = connected_components(links.union(more)) if not more.isEmpty() else found
    named = classes.join(final.withColumnRenamed("node", "cid"), "cid", "left")
    named = named.select("h1", "h2", "n", F.coalesce("component", "cid").alias("component"))
    linked = F.col("tokens").isNotNull() & F.col("id").isNotNull()
    plain = sets.where(~linked).select("id", "n", F.lit(None).cast(kind).alias("component"))  # linked with nothing, so never shuffled
    out = sets.where(linked).select("id", "n", "h1", "h2").join(named, ["h1", "h2", "n"], "left").select("id", "n", "component").union(plain)
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of documents without near duplicates: of each component the row with the least id, all null ids.

    Ids must be distinct; of rows that share an id all or none stay.
    """
    gone = near_duplicates(docs.select("doc_id", "text"), k, percent).where("component_id <> doc_id").select("doc_id").distinct()
    gone = cut(gone)
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
