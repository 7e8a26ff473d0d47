"""Sequence models: HMM and CRF potentials, forward-backward, Viterbi, and their segment forms.

Potentials of one sentence are an (n, S) array of emission scores and an (S + 1, S) array of transition
scores whose last row leaves the start. The kernels are NumPy over one sentence at a time; sentences
stay rows, the scores of their words come to blocks of them by a join, and only the transition table
(labels times labels) goes to the workers as a whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.session import cut, grows, parts, spread

NEG = -1e30
#: Bytes of a Viterbi step of all sentences that are taken together; it should stay in a core's cache.
VITERBI_ROOM = 1 << 20
#: What a label that a known word was never seen with scores.
BARRED = NEG / 1e25
#: Blocks of sentences for each partition of the session.
BLOCKS = 16


def log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def forward(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    f = np.empty_like(emit)
    f[0] = trans[-1] + emit[0]
    for t in range(1, len(emit)):
        f[t] = log_sum(f[t - 1][:, None] + trans[:-1], 0) + emit[t]
    return f


def backward(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    b = np.zeros_like(emit)
    for t in range(len(emit) - 2, -1, -1):
        b[t] = log_sum(trans[:-1] + (emit[t + 1] + b[t + 1])[None, :], 1)
    return b


def marginals(emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, float]:
    """Posterior of each label at each place, and the log partition."""
    f, b = forward(emit, trans), backward(emit, trans)
    z = float(log_sum(f[-1], 0))
    return np.exp(f + b - z), z


def transition_marginals(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """(n, S + 1, S): probability of each pair of labels; at the first place only the start leads."""
    f, b = forward(emit, trans), backward(emit, trans)
    z = log_sum(f[-1], 0)
    out = np.zeros((len(emit), *trans.shape))
    out[0, -1] = np.exp(trans[-1] + emit[0] + b[0] - z)
    for t in range(1, len(emit)):
        out[t, :-1] = np.exp(f[t - 1][:, None] + trans[:-1] + (emit[t] + b[t])[None, :] - z)
    return out


def viterbi(emit: np.ndarray, trans: np.ndarray) -> list[int]:
    """Best labels; of equal ones the first."""
    back = np.zeros(emit.shape, dtype=np.int64)
    s = trans[-1] + emit[0]
    for t in range(1, len(emit)):
        c = s[:, None] + trans[:-1]
        back[t] = c.argmax(axis=0)
        s = c.max(axis=0) + emit[t]
    out = [int(s.argmax())]
    for t in range(len(emit) - 1, 0, -1):
        out.append(int(back[t, out[-1]]))
    return out[::-1]


def posterior_decode(emit: np.ndarray, trans: np.ndarray) -> list[int]:
    return marginals(emit, trans)[0].argmax(axis=1).tolist()


def segment_scores(emit: np.ndarray, longest: list[int]) -> dict[tuple[int, int, int], float]:
    """Scores of (begin, end, label) as sums of token scores, up to each label's greatest length."""
    c = np.vstack([np.zeros(emit.shape[1]), np.cumsum(emit, axis=0)])
    n, s = emit.shape
    return {(b, e, y): float(c[e, y] - c[b, y]) for y in range(s) for b in range(n) for e in range(b + 1, min(n, b + longest[y]) + 1)}


def semi_forward(score: dict, trans: np.ndarray, n: int) -> np.ndarray:
    f = np.full((n + 1, trans.shape[1]), NEG)
    by_end: dict[int, list] = {}
    for (b, e, y), v in score.items():
        by_end.setdefault(e, []).append((b, y, v))
    for e in range(1, n + 1):
        parts: dict[int, list[float]] = {}
        for b, y, v in by_end.get(e, ()):
            into = trans[-1, y] if b == 0 else float(log_sum(f[b] + trans[:-1, y], 0))
            parts.setdefault(y, []).append(into + v)
        for y, xs in parts.items():
            f[e, y] = float(log_sum(np.array(xs), 0))
    return f


def semi_backward(score: dict, trans: np.ndarray, n: int) -> np.ndarray:
    g = np.full((n + 1, trans.shape[1]), NEG)
    g[n] = 0.0
    by_begin: dict[int, list] = {}
    for (b, e, y), v in score.items():
        by_begin.setdefault(b, []).append((e, y, v))
    for b in range(n - 1, 0, -1):
        outs = [trans[:-1, y] + v + g[e, y] for e, y, v in by_begin.get(b, ())]
        if outs:
            g[b] = log_sum(np.array(outs), 0)
    return g


def semi_marginals(score: dict, trans: np.ndarray, n: int) -> tuple[dict[tuple[int, int, int], float], float]:
    f, g = semi_forward(score, trans, n), semi_backward(score, trans, n)
    z = float(log_sum(f[n], 0))
    out = {}
    for (b, e, y), v in score.items():
        into = trans[-1, y] if b == 0 else float(log_sum(f[b] + trans[:-1, y], 0))
        out[b, e, y] = float(np.exp(into + v + g[e, y] - z))
    return out, z


def semi_viterbi(score: dict, trans: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    best = np.full((n + 1, trans.shape[1]), NEG)
    back: dict[tuple[int, int], tuple[int, int]] = {}
    for (b, e, y), v in sorted(score.items(), key=lambda x: (x[0][1], x[0][0], x[0][2])):
        if b == 0:
            s, p = trans[-1, y] + v, -1
        else:
            c = best[b] + trans[:-1, y]
            p = int(c.argmax())
            s = c[p] + v
        if s > best[e, y]:
            best[e, y] = s
            back[e, y] = (b, p)
    out, e, y = [], n, int(best[n].argmax())
    while e > 0:
        b, p = back[e, y]
        out.append((b, e, y))
        e, y = b, p
    return out[::-1]


def semi_posterior_decode(marg: dict[tuple[int, int, int], float], n: int, outside: int) -> list[tuple[int, int, int]]:
    """Segments of the greatest sum of marginals; outside segments are of length one and not given."""
    best, back = [0.0] * (n + 1), [(0, 0)] * (n + 1)
    for e in range(1, n + 1):
        best[e] = -1.0
        for b in range(e):
            for y in sorted({k[2] for k in marg if k[0] == b and k[1] == e}):
                if y == outside and e - b > 1:
                    continue
                s = best[b] + marg[b, e, y]
                if s > best[e]:
                    best[e], back[e] = s, (b, y)
    out, e = [], n
    while e > 0:
        b, y = back[e]
        if y != outside:
            out.append((b, e, y))
        e = b
    return out[::-1]


def hmm_tables(tagged: DataFrame, smooth_below: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(transitions, emissions, tags): log scores of (prev, cur), of (word, tag) and of tags for
    unknown words, from counts of (sent_id, pos, word, tag)."""
    from pyspark.sql import Window

    w = Window.partitionBy("sent_id").orderBy("pos")
    pairs = tagged.select(F.coalesce(F.lag("tag").over(w), F.lit("<s>")).alias("prev"), F.col("tag").alias("cur"))
    return _tables(pairs, grows(_words_tags(tagged)), smooth_below)


def hmm_tables_of(sentences: DataFrame, smooth_below: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """hmm_tables() of rows (tokens ARRAY<STRUCT<pos, word, tag>>), in order: no token is shuffled. The
    counts of words and tags are written once."""
    before = F.transform("tokens", lambda x, i: F.struct(F.when(i > 0, F.get("tokens", i - 1)["tag"]).otherwise("<s>").alias("prev"), x["tag"].alias("cur")))
    return _tables(sentences.select(F.inline(before)), grows(cut(_words_tags(sentences.select(F.inline("tokens"))))), smooth_below)


def _words_tags(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("word", "tag").agg(F.count(F.lit(1)).alias("ctw"))


def _tables(pairs: DataFrame, c: DataFrame, smooth_below: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    from pyspark.sql import Window

    t = pairs.groupBy("prev", "cur").agg(F.count(F.lit(1)).alias("n"))
    t = t.select("prev", "cur", F.log(F.col("n") / F.sum("n").over(Window.partitionBy("prev"))).alias("score"))
    cw = c.groupBy("word").agg(F.sum("ctw").alias("cw"))
    ct = c.groupBy("tag").agg(F.sum("ctw").alias("ct"))
    size = c.agg(F.countDistinct("word").alias("v"), F.sum("ctw").alias("total"))
    e = c.join(cw, "word").join(F.broadcast(ct), "tag").crossJoin(F.broadcast(size))  # tags are few, size is one row
    low = F.col("cw") < smooth_below
    cw2, ctw2 = F.when(low, F.col("cw") + 1).otherwise(F.col("cw")), F.when(low, F.col("ctw") + F.col("ct") / F.col("v")).otherwise(F.col("ctw"))
    score = F.log(cw2 / (F.col("total") + 1)) + F.log(ctw2 / cw2) - F.log(F.col("ct") / F.col("total"))
    u = ct.crossJoin(F.broadcast(size)).select("tag", (F.log(F.lit(1.0) / (F.col("total") + 1)) + F.log(F.col("ct") / F.col("v")) - F.log(F.col("ct") / F.col("total"))).alias("score"))
    return t, e.select("word", "tag", score.alias("score")), u


def block_of(spark, sent_id: str = "sent_id") -> Column:
    """A sentence's block: there are BLOCKS for each partition of the session."""
    return F.pmod(F.xxhash64(sent_id), F.lit(BLOCKS * parts(spark))).cast("int")


def decode(tokens: DataFrame, tables: tuple[DataFrame, DataFrame, DataFrame], mode: str = "viterbi") -> DataFrame:
    """decode_rows() of tokens (sent_id, pos, word)."""
    s = spread(tokens.select(block_of(tokens.sparkSession).alias("block"), "sent_id", F.struct("pos", "word").alias("x")), "block")
    s = s.groupBy("block", "sent_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return decode_rows(s.select("block", "sent_id", F.col("x.pos").alias("pos"), F.col("x.word").alias("words")), tables, mode)


def decode_rows(sentences: DataFrame, tables: tuple[DataFrame, DataFrame, DataFrame], mode: str = "viterbi") -> DataFrame:
    """(sent_id, pos, tag) for rows (block, sent_id, pos ARRAY<INT>, words) that are spread by block_of():
    best labels; with mode `posterior` the likeliest label of each place and `prob`, its posterior.

    The different words of a block are joined with their scores, so no worker holds the lexicon and no
    token is shuffled. A word brings the labels it was seen with; all others are barred.
    """
    t, e, u = tables
    trans_rows, unknown = t.collect(), {r["tag"]: r["score"] for r in u.collect()}  # labels squared, labels
    labels = sorted(unknown)
    of = {y: i for i, y in enumerate(labels)}
    trans = np.full((len(labels) + 1, len(labels)), -20.0)
    for r in trans_rows:
        trans[of.get(r["prev"], len(labels)), of[r["cur"]]] = r["score"]
    base = np.array([unknown[y] for y in labels], dtype=np.float32)
    number = F.map_from_arrays(F.lit(labels), F.sequence(F.lit(0), F.lit(len(labels) - 1)))
    seen = F.array_sort(F.collect_list(F.struct(F.try_element_at(number, F.col("tag")).alias("y"), F.col("score").cast("float").alias("score"))))
    known = grows(e.groupBy("word").agg(seen.alias("seen")))
    asked = grows(sentences.select(F.col("block").alias("lot"), F.explode(F.array_distinct("words")).alias("word")).distinct())
    lexicon = asked.join(known, "word").select("lot", "word", F.col("seen.y").alias("ys"), F.col("seen.score").alias("scores"))
    kind = sentences.schema["sent_id"].dataType.simpleString()
    names = pa.array(labels, pa.string())

    def run(s: pa.Table, lex: pa.Table) -> pa.Table:
        s, lex = s.combine_chunks(), lex.combine_chunks()
        ids = s.column("sent_id")
        words, pos, sizes = _flat(s.column("words"))[0], *_flat(s.column("pos"))
        codes = pc.index_in(words, value_set=lex.column("word")).fill_null(len(lex)).to_numpy(zero_copy_only=False).astype(np.int64)
        ys, many = _flat(lex.column("ys"))
        # the last entry is that of unknown words: all labels
        entries = Entries(np.r_[many, len(labels)], np.r_[_numbers(ys, np.int64), np.arange(len(labels))], np.r_[_numbers(_flat(lex.column("scores"))[0], np.float32), base].astype(np.float64))
        out = [ids.take(pa.array(np.repeat(np.arange(len(s)), sizes))), pos.cast(pa.int32())]
        if mode == "viterbi":
            best, more = entries.viterbi(codes, sizes, trans), []
        else:
            best, prob = entries.posterior(codes, sizes, trans)
            more = [pa.array(np.round(prob, 6))]
        return pa.Table.from_arrays([*out, names.take(pa.array(best)), *more], names=["sent_id", "pos", "tag", *(["prob"] if more else [])])

    def both(key: tuple, s: pa.Table, lex: pa.Table) -> pa.Table:
        return run(s, lex)

    return sentences.groupBy("block").cogroup(lexicon.groupBy("lot")).applyInArrow(both, f"sent_id {kind}, pos int, tag string" + ("" if mode == "viterbi" else ", prob double"))


def _flat(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists, and how many each list has."""
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x
    return x.flatten(), pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64)


def _numbers(x: pa.Array, kind) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False).astype(kind)


class Entries:
    """The labels (ascending) and scores that words may take: many[i] of them for word i, one after another."""

    def __init__(self, many: np.ndarray, labels: np.ndarray, scores: np.ndarray):
        self.many, self.labels, self.scores = many, labels, scores
        self.start = np.cumsum(many) - many

    def viterbi(self, codes: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> np.ndarray:
        """batch_viterbi() of sentences of any lengths over the labels that their words may take: tokens'
        words are codes, those of a sentence one after another. A label for each token."""
        many = self.many[codes]
        start = np.cumsum(many) - many
        flat = np.repeat(self.start[codes] - start, many) + np.arange(many.sum())
        labels, score, back = self.labels[flat], self.scores[flat], np.zeros(len(flat), dtype=np.int32)
        into = np.ascontiguousarray(trans[:-1].T)
        begin = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        begin, longer = begin[order], -sizes[order]
        alive = [int(np.searchsorted(longer, -t, "left")) for t in range(int(sizes.max(initial=0)) + 1)]  # sentences of more than t tokens
        first = begin[: alive[0]]
        at = np.repeat(start[first], many[first]) + _places(many[first])
        score[at] += trans[-1, labels[at]]
        kind = np.ceil(np.log2(many) / 2).astype(np.int64)  # tokens with about as many labels are taken together
        for t in range(1, len(alive) - 1):
            cur = begin[: alive[t]] + t
            key = kind[cur - 1] * 64 + kind[cur]
            by = np.argsort(key, kind="stable")
            for part in np.split(cur[by], np.flatnonzero(np.diff(key[by])) + 1):
                a, b = int(many[part - 1].max()), int(many[part].max())
                lot = max(1, VITERBI_ROOM // (8 * a * b))
                for i in range(0, len(part), lot):
                    y = part[i : i + lot]
                    x = y - 1
                    has, some = np.arange(a) < many[x][:, None], np.arange(b) < many[y][:, None]
                    frm, to = start[x][:, None] + np.where(has, np.arange(a), 0), start[y][:, None] + np.where(some, np.arange(b), 0)
                    c = np.where(has, score[frm], -np.inf)[:, None, :] + into[labels[to][:, :, None], labels[frm][:, None, :]]
                    best = c.argmax(axis=2)
                    put = to[some]
                    back[put] = best[some]
                    score[put] += np.take_along_axis(c, best[:, :, None], axis=2)[:, :, 0][some]
        chosen = np.zeros(len(codes), dtype=np.int64)
        if len(first):
            last = (np.cumsum(sizes) - 1)[sizes > 0]
            place, ends = _places(many[last]), np.cumsum(many[last]) - many[last]
            s = score[np.repeat(start[last], many[last]) + place]
            chosen[last] = np.minimum.reduceat(np.where(s == np.repeat(np.maximum.reduceat(s, ends), many[last]), place, len(trans)), ends)
        for t in range(len(alive) - 2, 0, -1):
            cur = begin[: alive[t]] + t
            chosen[cur - 1] = back[start[cur] + chosen[cur]]
        return labels[start + chosen]

    def posterior(self, codes: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest label of each token and its posterior, barred labels included."""
        best, prob, begin = np.zeros(len(codes), dtype=np.int64), np.zeros(len(codes)), np.cumsum(sizes) - sizes
        for n in np.unique(sizes[sizes > 0]).tolist():  # sentences of one length go through the recursions together
            rows = begin[sizes == n]
            for i in range(0, len(rows), 256):
                at = rows[i : i + 256, None] + np.arange(n)
                w = codes[at].ravel()
                place = _places(self.many[w])
                emit = np.full((len(w), trans.shape[1]), BARRED)
                from_ = np.repeat(self.start[w], self.many[w]) + place
                emit[np.repeat(np.arange(len(w)), self.many[w]), self.labels[from_]] = self.scores[from_]
                m = batch_marginals(emit.reshape(*at.shape, -1), trans)
                best[at] = m.argmax(axis=2)
                prob[at] = np.take_along_axis(m, best[at][..., None], axis=2)[..., 0]
        return best, prob


def _places(many: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n."""
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def batch_viterbi(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """viterbi for (B, n, S) scores of sentences of one length: (B, n) labels."""
    size, n, labels = emit.shape
    step = max(1, VITERBI_ROOM // (8 * labels * labels))
    if size > step:
        return np.concatenate([batch_viterbi(emit[at : at + step], trans) for at in range(0, size, step)])
    back = np.zeros(emit.shape, dtype=np.int32)
    into = np.ascontiguousarray(trans[:-1].T)  # the labels before are the last axis, which is searched fastest
    s = trans[-1] + emit[:, 0]
    for t in range(1, n):
        c = s[:, None, :] + into
        back[:, t] = c.argmax(axis=2)
        s = np.take_along_axis(c, back[:, t][:, :, None].astype(np.int64), axis=2)[:, :, 0] + emit[:, t]
    out = np.empty(emit.shape[:2], dtype=np.int64)
    out[:, -1] = s.argmax(axis=1)
    for t in range(n - 1, 0, -1):
        out[:, t - 1] = np.take_along_axis(back[:, t], out[:, t][:, None], axis=1)[:, 0]
    return out


def batch_marginals(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """marginals for (B, n, S) scores: each step is one matrix product of scaled probabilities."""
    n = emit.shape[1]
    top = trans.max()
    move = np.exp(trans[:-1] - top)
    f, b = np.empty_like(emit), np.zeros_like(emit)
    f[:, 0] = trans[-1] + emit[:, 0]
    for t in range(1, n):
        m = f[:, t - 1].max(axis=1, keepdims=True)
        f[:, t] = np.log(np.exp(f[:, t - 1] - m) @ move + 1e-300) + m + top + emit[:, t]
    for t in range(n - 2, -1, -1):
        x = emit[:, t + 1] + b[:, t + 1]
        m = x.max(axis=1, keepdims=True)
        b[:, t] = np.log(np.exp(x - m) @ move.T + 1e-300) + m + top
    z = log_sum(f[:, -1], 1)
    return np.exp(f + b - z[:, None, None])
