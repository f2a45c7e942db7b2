"""The Kneser-Ney models against plain Python: every distribution sums to one, and texts get the same features."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from hushpage.llm import toxicity as tx

WORDS = ["awful", "nastily", "nastier", "blue", "greenish", "greenest", "in", "of", "tree", "house", "houses", "walk"]


def make(seed, n=220):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        w = [r.choice(WORDS[3:]) for _ in range(r.randrange(0, 14))]
        if i % 4 == 0:
            w[len(w) // 2 : len(w) // 2] = r.choice([["awful", "tree"], ["nastily"], ["nastier", "nastily"], ["in", "awful"]])
        rows.append((" ".join(w) if i % 17 else None, int(i % 4 == 0)))
    return rows


def stem_of(word):
    return word if len(word) <= 5 else word[:5] + "-"


class Plain:
    """The four levels written out as probabilities of words, for one threshold."""

    def __init__(self, rows, threshold):
        self.c = [Counter(), Counter()]
        held = [[Counter(), Counter()] for _ in range(3)]  # documents of each class by pair, word, stem
        for text, toxic in rows:
            ws = (text or "").lower().split()
            pairs = set(zip(["<s>", *ws], ws))
            self.c[1 - toxic].update(pairs)
            for level, seen in enumerate((pairs, set(ws), {stem_of(w) for w in ws})):
                held[level][1 - toxic].update(seen)
        self.share = sum(t for _, t in rows) / len(rows)

        def sure(level, x):
            t, n = held[level][0][x], held[level][0][x] + held[level][1][x]
            e = n * self.share
            return abs(t - e) / math.sqrt(e * (1 - self.share) + 1) >= threshold

        self.vocabulary = sorted({w for _, w in self.c[0] | self.c[1]})
        stems = sorted({stem_of(w) for w in self.vocabulary})
        self.p_pair, self.p_word, taken_word, taken_stem, kept_stem, totals = [], [], [], [], [], []
        for c in self.c:
            k = Counter(w for _, w in c)
            kept = {w: max(k[w] - tx.DISCOUNT, 0) if sure(1, w) else 0 for w in self.vocabulary}
            taken = {w: k[w] - kept[w] for w in self.vocabulary}
            g = Counter()
            for w, x in taken.items():
                g[stem_of(w)] += x
            ks = {s: max(g[s] - tx.DISCOUNT, 0) if sure(2, s) else 0 for s in stems}
            totals.append((sum(k.values()), sum(g.values())))
            taken_word.append(taken), kept_stem.append(ks), taken_stem.append({s: g[s] - ks[s] for s in stems})
            self.p_word.append({w: kept[w] / totals[-1][0] for w in self.vocabulary})
        left = sum(sum(t.values()) for t in taken_stem)
        unseen = tx.DISCOUNT * len(stems) / left / (len(stems) + 1)
        shared = {s: max(taken_stem[0][s] + taken_stem[1][s] - tx.DISCOUNT, 0) / left + unseen for s in stems}
        size = Counter()
        for w in self.vocabulary:
            size[stem_of(w)] += taken_word[0][w] + taken_word[1][w]
        self.unknown = [0.0, 0.0]
        for y in (0, 1):
            l1, l2 = sum(taken_word[y].values()) / totals[y][0], sum(taken_stem[y].values()) / totals[y][1]
            stem = {s: kept_stem[y][s] / totals[y][1] + l2 * shared[s] for s in stems}
            for w in self.vocabulary:
                self.p_word[y][w] += l1 * stem[stem_of(w)] * (taken_word[0][w] + taken_word[1][w]) / (size[stem_of(w)] + 1)
            self.unknown[y] = l1 * (l2 * unseen + sum(stem[s] / (size[s] + 1) for s in stems))  # a new stem, or a new word of a known one
            self.of_stem = {**getattr(self, "of_stem", {}), **{(y, s): l1 * stem[s] / (size[s] + 1) for s in stems}, (y, None): l1 * l2 * unseen}
            total, kept = Counter(), defaultdict(dict)
            for (v, w), n in self.c[y].items():
                total[v] += n
            for v, w in self.c[0] | self.c[1]:
                if sure(0, (v, w)):
                    kept[v][w] = max(self.c[y][v, w] - tx.DISCOUNT, 0) / max(total[v], 1)
            self.p_pair.append(kept)

    def p(self, y, v, w):
        kept = self.p_pair[y][v] if v in self.p_pair[y] else {}
        low = self.p_word[y].get(w)
        if low is None:
            low = self.of_stem.get((y, stem_of(w)), self.of_stem[y, None]) if w is not None else self.unknown[y]
        return kept.get(w, 0) + (1 - sum(kept.values())) * low

    def gap(self, text):
        ws = (text or "").lower().split()
        return sum(math.log(self.p(0, v, w) / self.p(1, v, w)) for v, w in zip(["<s>", *ws], ws)), max(len(ws), 1)


@pytest.mark.parametrize("threshold", [3.0, 5.0])
def test_against_plain_python(spark, threshold):
    rows = make(2)
    plain = Plain(rows, threshold)
    for y in (0, 1):
        for v in ["<s>", *plain.vocabulary]:
            assert math.isclose(sum(plain.p(y, v, w) for w in [*plain.vocabulary, None]), 1, abs_tol=1e-9)
    assert any(plain.p_pair[0].values())
    df = spark.createDataFrame(rows, "text string, toxic int").repartition(3)
    model = tx.KneserNey(*tx.count_tables(df, plain.share), plain.share, threshold)
    texts = [t for t, _ in rows[:60]] + ["awful unheard nastiness", "walks in greener houses", "", None]
    got = model.features(tx.Expressions([(t or "").encode() for t in texts]))
    for text, (mean, root) in zip(texts, got):
        gap, n = plain.gap(text)
        assert math.isclose(mean, gap / n, abs_tol=1e-7) and math.isclose(root, gap / math.sqrt(n), abs_tol=1e-7)


def test_null_ids_one_class_and_long_texts(spark):
    docs = spark.createDataFrame([(None, "awful"), (1, "fine " * 300_000), (2, ""), (3, "awful tree")], "doc_id long, text string")
    for labels in ([(1, 0), (2, 0)], [(2, 1), (3, None)], [(2, 1), (1, 0)]):
        got = tx.toxicity_scores(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 and np.isfinite(r.score) for r in got)
