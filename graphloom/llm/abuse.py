"""Abusive, hateful or sexually explicit language (problem 9): a classifier chain over segments of texts."""

from __future__ import annotations

import itertools
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.shared import materialise

#: Order of the chain; the last link predicts the rated label.
CHAIN = ("sexual", "hate", "threat", "insult", "abusive")
BITS = 18
#: The classifier is fitted on at most this many labelled documents (those with the least hash of their id).
MAX_LABELLED = 20_000
FOLDS = 4
#: Weight of a feature that every document holds.
LEAST_WEIGHT = 0.02

# --- fixed values: seed cues of each category in en, de, fr, es, ru, ja --------------------------------
CUES = {
    "sexual": "cock, dick, pussy, cunt, tits, boobs, nude, nudes, naked, horny, fuck, fucking, fucked, porn, blowjob, anal, orgasm, moaning, stroked her, begged him, hardcore, cam girls, ficken, fotze, titten, schwanz, nackt, geil, muschi, bite, chatte, baiser, nue, nues, salope, seins nus, polla, coño, follar, tetas, desnuda, desnudas, mamada, хуй, пизда, ебать, трахать, сиськи, голые, порно, минет, セックス, エロ, 裸, ちんこ, まんこ, 巨乳, ポルノ, 中出し",
    "hate": "subhuman, subhumans, vermin, parasites, ship them off, round up, wipe them out, go back to, all thieves, move in, your kind, your sort, breed like, ungeziefer, untermenschen, müssen raus, abschaum, vermine, dehors, ratas, hay que echarlos, basura humana, мразь, гнать, нелюди, отребье, 害虫, 追い出せ, 劣等",
    "threat": "kill yourself, go die, and die, hang yourself, drink bleach, break your legs, break your neck, break your arms, smash your, i will find you, know where you live, beat you, shoot you, stab you, rape, burn you, dead or alive, locked up and, hurt you, suffer, verrecke, bring dich um, häng dich, schlag dich, stirb, crève, va mourir, te tuer, muérete, voy a matar, matarte, сдохни, убью, умри, повесься, 死ね, 殺す, くたばれ, 消えろ",
    "insult": "idiot, idiots, imbecile, imbeciles, moron, morons, stupid, retard, retarded, loser, losers, pathetic, worthless, brainless, spineless, jackass, asshole, dipshit, dirtbag, bastard, bitch, scum, halfwit, dumbass, waste of oxygen, waste of space, waste of air, shut up, shut your mouth, piss off, stand you, useless, wichser, arschloch, vollidiot, fresse, missgeburt, hurensohn, schlampe, connard, connasse, gueule, abruti, enculé, pute, imbécil, gilipollas, hijo de puta, pendejo, cállate, idiota, cabrón, урод, тупой, тупая, дебил, заткнись, идиот, сука, мудак, クズ, バカ, 馬鹿, ゴミ, アホ, 間抜け, 役立たず",
}
CUES = {k: v.split(", ") for k, v in CUES.items()}
#: look-alike letters and digits
HOMOGLYPHS = ("аеорсухіѕјոһԁɡḷıοѵ", "aeopcyxisjnhdgliov")
LEET = ("013457@$!", "oieastasi")
INVISIBLE = "[­​-‏‪-‮⁠﻿̀-ͯ]"
# --- end of fixed values -------------------------------------------------------------------------------

_LETTER = r"[^\W\d_]"
_CJK = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
_PIECE = re.compile(rf"[^\s{_CJK}。！？]+|[{_CJK}。！？\n]")
_WORD = re.compile(rf"[a-z]+(?!{_LETTER}|\*)|{_LETTER}\*{{2,}}{_LETTER}*|{_LETTER}+|[.!?…]$")
_APART = re.compile(rf"(?<!{_LETTER}){_LETTER}(?:[.\-_ ]{{1,2}}{_LETTER}(?!{_LETTER})){{2,}}")
_INVISIBLE = re.compile(INVISIBLE)
_LEET = re.compile(rf"{_LETTER}[{re.escape(LEET[0])}]+{_LETTER}|(?<!\w)[1345@$]{_LETTER}")
_TO_LATIN, _FROM_LEET = str.maketrans(*HOMOGLYPHS), str.maketrans(*LEET)
_TO_CYRILLIC = str.maketrans("aeopcyx", "аеорсух")
_CYRILLIC = re.compile("[бвгдзийклмнптфцчшщъыьэюя]")
_RUN = re.compile(rf"{_LETTER}+")
_REPEAT = re.compile(rf"({_LETTER})\1+")
#: distinct words that a worker remembers; beyond that it starts anew
MEMO = 500_000


def _squeeze(word: str) -> str:
    """The word as it reads after repeated letters are squeezed."""
    return _REPEAT.sub(r"\1", word)


def _one_script(m: re.Match) -> str:
    """A word of mixed letters in the script that its unambiguous letters have."""
    w = m.group()
    if w.isascii() or not re.search("[a-z]", w):
        return w
    return w.translate(_TO_CYRILLIC if _CYRILLIC.search(w) else _TO_LATIN)


def _together(m: re.Match) -> str:
    """Letters set apart as one word; two blanks part words."""
    return " ".join(re.sub(r"[.\-_ ]", "", part) for part in m.group().split("  "))


def plain_word(piece: str) -> str:
    """A blank-free piece of lower-case text with disguises undone: invisible marks, look-alikes, leet, repeats."""
    if not piece.isascii():
        piece = _RUN.sub(_one_script, _INVISIBLE.sub("", piece))
    if _LEET.search(piece) and not re.fullmatch(r"\w{2,20}\d:", piece):
        core = piece.rstrip("!.?…,;:")
        piece = core.translate(_FROM_LEET) + piece[len(core) :].replace("!", ".")
    return _squeeze(piece)


def _code(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) - 2**31 or 1


#: follows every word whose inner letters are masked
_MASKED = _code("**")


class _Memo(dict):
    """Tokens of each distinct piece: it is read once per worker, however often it occurs."""

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= MEMO:
            self.clear()
        if piece in "\n。！？":
            out = (0,)
        else:
            out = tuple(c for w in _WORD.findall(plain_word(piece)) for c in (0 if w in ".!?…" else _code(w), *([_MASKED] if "*" in w else ())))
        self[piece] = out
        return out


_memo = _Memo()


def word_codes(text: str) -> list[int]:
    """Codes of the words of a text in order, 0 between sentences and lines; a word repeated at once counts once."""
    text = text.lower()
    memo = _memo
    out = [c for p in _PIECE.findall(_APART.sub(_together, text)) for c in memo[p]]
    return [c for c, last in zip(out, [0, *out]) if c != last or not c]


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, toks) of every non-null text: codes of its words in order, 0 between sentences and lines.

    One splitting pass over the text; disguises are undone on distinct words.
    """

    def run(batches):
        for b in batches:
            got = [word_codes(t) for t in b.column("text").to_pylist()]
            at = np.cumsum([0, *map(len, got)])
            flat = np.fromiter(itertools.chain.from_iterable(got), np.int64, at[-1]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))], ["doc_id", "toks"])

    return docs.where(F.col("text").isNotNull()).select("doc_id", "text").mapInArrow(run, "doc_id bigint, toks array<int>")


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) + np.uint64(0x7F4A7C15))
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@dataclass
class Cues:
    """Seed cues by the full hash of their last run of words; a bitmap sorts out nearly all features first."""

    near: np.ndarray  # 2**BITS flags
    hashes: np.ndarray  # sorted
    bits: np.ndarray  # categories of each, one bit a category

    def of(self, full: np.ndarray, feats: np.ndarray) -> np.ndarray:
        out = np.zeros(len(full), np.uint8)
        some = np.flatnonzero(self.near[feats])
        at = np.minimum(np.searchsorted(self.hashes, full[some]), len(self.hashes) - 1)
        hit = self.hashes[at] == full[some]
        out[some[hit]] = self.bits[at[hit]]
        return out


@dataclass
class Grams:
    """Words and runs of two and three words of segments (sentences or lines)."""

    flat: np.ndarray  # feature of each
    of: np.ndarray  # its segment
    doc: np.ndarray  # document of each segment
    cues: np.ndarray | None = None  # categories of each feature, one bit a category
    told: np.ndarray | None = None  # whether it shares a word with a cue

    @property
    def n(self) -> int:
        return len(self.doc)


_MASK = np.uint64((1 << BITS) - 1)


def _runs(t: np.ndarray, g: np.ndarray):
    """Full hashes of words, pairs and triples; which pairs and triples lie in one segment."""
    one = _mix(t.astype(np.int64).view(np.uint64), np.zeros(len(t), np.uint64))
    same2 = g[1:] == g[:-1]
    two = _mix(one[:-1], one[1:])
    return one, two, _mix(two[:-1], one[2:]), same2, same2[1:] & same2[:-1]


def _grams(toks: np.ndarray, doc: np.ndarray, known: Cues | None = None) -> Grams:
    keep = toks != 0
    new = np.r_[True, (doc[1:] != doc[:-1]) | ~keep[:-1]] if len(toks) else np.zeros(0, bool)
    seg = np.cumsum(new) - 1
    t, g, d = toks[keep], seg[keep], doc[keep]
    if not len(t):
        none = np.zeros(0, np.int64)
        return Grams(none, none, np.zeros(0, doc.dtype), np.zeros(0, np.uint8), np.zeros(0, bool))
    _, first, g = np.unique(g, return_index=True, return_inverse=True)
    one, two, three, same2, same3 = _runs(t, g)
    full = np.concatenate([one, two[same2], three[same3]])
    feats = (full & _MASK).astype(np.int64)
    out = Grams(feats, np.concatenate([g, g[1:][same2], g[2:][same3]]), d[first])
    if known is not None:
        out.cues = known.of(full, feats)
        own = out.cues[: len(one)] > 0
        starts = (np.flatnonzero(same2), np.flatnonzero(same3))
        ends = len(one) + len(starts[0])
        for width, at, hit in ((2, starts[0], out.cues[len(one) : ends]), (3, starts[1], out.cues[ends:])):
            for k in range(width):
                own[at[hit > 0] + k] = True
        out.told = np.concatenate([own, (own[1:] | own[:-1])[same2], (own[2:] | own[1:-1] | own[:-2])[same3]])
    return out


def seed_cues() -> Cues:
    """The cues of all categories; also with all but the outer letters masked. Of longer cues the first three words count."""
    found: dict[int, int] = {}
    for k, c in enumerate(CHAIN[:-1]):
        for cue in CUES[c]:
            forms = [word_codes(cue)[:3]]
            if " " not in cue and len(cue) > 3 and cue[0] < "\u0250":
                forms.append([_code(f"{cue[0]}{'*' * (len(cue) - 2)}{cue[-1]}")])
            for codes in forms:
                h = int(_runs(np.array(codes), np.zeros(len(codes), np.int64))[len(codes) - 1][-1])
                found[h] = found.get(h, 0) | 1 << k
    hashes = np.array(sorted(found), np.uint64)
    near = np.zeros(1 << BITS, bool)
    near[(hashes & _MASK).astype(np.int64)] = True
    return Cues(near, hashes, np.array([found[int(h)] for h in hashes], np.uint8))


@dataclass
class Chain:
    """Weights of each link over hashed features, cues and the probabilities of the links before it."""

    words: np.ndarray  # links x 2**BITS
    cues: np.ndarray  # links x 4
    before: np.ndarray  # links x links
    bias: np.ndarray
    threshold: float = 0.2
    known: Cues | None = None
    rare: np.ndarray | None = None  # weight of each feature


def commonness(toks: DataFrame) -> np.ndarray:
    """Weight of each feature out of the share of all documents that hold it: 1 for the rare, falling with the square of its inverse document frequency to ``LEAST_WEIGHT``, never 0.

    Every document counts; a task sends one count per feature, of which there are 2**BITS.
    """

    def run(batches):
        total, n = np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            col = b.column("toks")
            sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
            g = _grams(pc.list_flatten(col).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes))
            n += len(sizes)
            if g.n:
                total += np.bincount(np.unique(g.flat * np.int64(len(sizes)) + g.doc[g.of]) // len(sizes), minlength=1 << BITS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1], pa.int32()), pa.array(np.r_[total[some], n], pa.int64())], ["f", "n"])

    got = toks.select("toks").mapInArrow(run, "f int, n bigint").groupBy("f").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << BITS)
    own = got[got["f"] >= 0]
    df[own["f"].to_numpy()] = own["n"].to_numpy()
    n = max(2.0, float(got.loc[got["f"] < 0, "n"].sum()))
    return np.clip((np.log(n / np.maximum(df, 1)) / np.log(n)) ** 2, LEAST_WEIGHT, 1)


class _Rows:
    """Sparse rows: features with the row they belong to, in row order."""

    def __init__(self, g: Grams, rare: np.ndarray):
        order = np.argsort(g.of, kind="stable")
        self.n = n = g.n
        self.flat, self.of = g.flat[order], g.of[order]
        self.scale = 1 / np.sqrt(np.maximum(np.bincount(self.of, minlength=n), 1))
        bits = g.cues[order]
        self.cues = np.stack([np.bincount(self.of, bits >> k & 1, n) > 0 for k in range(4)], 1).astype(float)
        self.value = rare[self.flat]
        #: the same without what shares a word with a cue
        self.other = np.where(g.told[order], 0.0, self.value)

    def take(self, keep: np.ndarray) -> _Rows:
        out = object.__new__(_Rows)
        to = np.full(self.n, -1)
        to[keep] = np.arange(len(keep))
        own = to[self.of] >= 0
        out.n, out.flat, out.of, out.value, out.other = len(keep), self.flat[own], to[self.of[own]], self.value[own], self.other[own]
        out.scale, out.cues = self.scale[keep], self.cues[keep]
        return out

    def withheld(self) -> _Rows:
        """Rows whose cues are hidden."""
        out = object.__new__(_Rows)
        out.__dict__.update(self.__dict__)
        out.value, out.cues = self.other, np.zeros((self.n, 0))
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, w[self.flat] * self.value, self.n) * self.scale

    def grad(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, (r * self.scale)[self.of] * self.value, 1 << BITS)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(x: _Rows, dense: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 70, l2: float = 2e-2):
    """Logistic regression by full-batch AdaGrad; returns (word weights, dense weights, bias)."""
    w, v, b = np.zeros(1 << BITS), np.zeros(dense.shape[1]), -2.0
    gw, gv, gb = np.full(1 << BITS, 1e-6), np.full(dense.shape[1], 1e-6), 1e-6
    for _ in range(steps):
        r = (_sigmoid(x.dot(w) + dense @ v + b) - y) * weight
        dw, dv, db = x.grad(r) + l2 * w, dense.T @ r + 0.05 * v, r.sum()
        gw += dw * dw
        gv += dv * dv
        gb += db * db
        w -= 0.5 * dw / np.sqrt(gw)
        v -= 0.5 * dv / np.sqrt(gv)
        b -= 0.5 * db / np.sqrt(gb)
    return w, v, b


def _fit_chain(all_rows: _Rows, keep, target, weight, fold) -> Chain:
    """Links in order; a later link sees the earlier ones' probabilities as predicted by models of the other folds.

    The cues vote for the categories and are hidden from their links, which learn from the words around them; the last link sees all.
    """
    x = all_rows.take(keep)
    k = len(CHAIN)
    out = Chain(np.zeros((k, 1 << BITS)), np.zeros((k, 4)), np.zeros((k, k)), np.zeros(k))
    probs = np.zeros((len(keep), 0))
    for j in range(k):
        y, own = target[:, j], x if j == k - 1 else x.withheld()
        dense = np.hstack([own.cues, probs])
        w, v, b = _fit(own, dense, y, weight)
        c = own.cues.shape[1]
        out.words[j], out.cues[j, :c], out.before[j, :j], out.bias[j] = w, v[:c], v[c:], b
        if j < k - 1:
            oof = np.zeros(len(keep))
            for f in range(FOLDS):
                tr, te = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                if len(tr) and len(te):
                    wf, vf, bf = _fit(own.take(tr), dense[tr], y[tr], weight[tr], steps=30)
                    oof[te] = _sigmoid(own.take(te).dot(wf) + dense[te] @ vf + bf)
            probs = np.hstack([probs, oof[:, None]])
    return out


def _predict(words, cues, before, bias, x: _Rows) -> np.ndarray:
    """Probabilities of all links; those of the categories then also count the cues of what is abusive."""
    p, hidden = np.zeros((x.n, len(CHAIN))), x.withheld()
    for j in range(len(CHAIN)):
        last = j == len(CHAIN) - 1
        p[:, j] = _sigmoid((x if last else hidden).dot(words[j]) + (x.cues @ cues[j] if last else 0) + p[:, :j] @ before[j, :j] + bias[j])
    p[:, :4] = 1 - (1 - p[:, :4]) * (1 - x.cues * p[:, 4:])
    return p


def train(toks: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Chain:
    """Fit the chain on the labelled documents of (doc_id, toks).

    Votes of 0 and 1 are averaged per document, null votes are left out, ties
    are not used, repeated rows count once. The categories have no labels of
    their own: within abusive documents the seed cues vote for a segment's categories,
    and the links of the categories learn from the words around the cues. Which segments of such a document are the abusive ones is settled by
    alternation: fit, pick the segments that the fit finds abusive (at least
    the likeliest one), fit again. Without labels of both kinds the seed cues alone decide.
    """
    votes = labels.where(F.col("abusive").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "rater", "abusive").distinct().groupBy("doc_id").agg(F.avg("abusive").alias("y")).where(F.col("y") != 0.5)
    votes = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    chosen = materialise(votes, "votes")
    rows = toks.join(chosen, "doc_id").toPandas()
    k = len(CHAIN)
    known, rare = seed_cues(), commonness(toks)
    seeds = Chain(np.zeros((k, 1 << BITS)), np.zeros((k, 4)), np.zeros((k, k)), np.full(k, -2.0))
    seeds.cues[4] = 4.0
    seeds.known, seeds.rare = known, rare
    if rows.empty or rows["y"].lt(0.5).all() or rows["y"].gt(0.5).all():
        return seeds
    rows = rows.sort_values("doc_id", kind="stable").reset_index(drop=True)
    sizes = rows["toks"].map(len).to_numpy()
    g = _grams(np.concatenate([np.asarray(t, np.int64) for t in rows["toks"]]), np.repeat(np.arange(len(rows)), sizes), known)
    x = _Rows(g, rare)
    doc = rows["doc_id"].to_numpy()[g.doc]
    y = rows["y"].to_numpy()[g.doc] > 0.5
    fold_of = (doc * 2654435761 % 2**32 // 7) % FOLDS
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(doc)]))
    hot = x.cues.sum(1) > 0
    any_hot = np.bincount(group, hot) > 0
    picked = y & (hot | ~any_hot[group])
    weight = np.where(y, np.where(hot, 1.0, 1 / np.bincount(group)[group]), 1.0)
    for turn in range(3):
        keep = np.flatnonzero(~y | picked)
        target = np.zeros((len(keep), k))
        target[:, 4] = picked[keep]
        target[:, :4] = x.cues[keep] * picked[keep][:, None]
        own = weight[keep] * np.where(picked[keep], 4.0, 1.0)
        if turn == 2:
            model = _fit_chain(x, keep, target, own, fold_of[keep])
            model.known, model.rare = known, rare
            return model
        # the documents' segments as models of the other folds see them, else a picked segment confirms itself
        p = np.zeros(len(doc))
        for f in range(FOLDS):
            t, te = np.flatnonzero(fold_of[keep] != f), np.flatnonzero(fold_of == f)
            if len(t) and len(te):
                w, v, b = _fit(x.take(keep[t]), x.cues[keep[t]], target[t, 4], own[t], steps=40)
                p[te] = _sigmoid(x.take(te).dot(w) + x.cues[te] @ v + b)
        best = np.maximum.reduceat(p, starts)
        picked = y & ((p > 0.5) | ((p >= best[group]) & (p > 0.2)))
        weight = np.ones(len(doc))


def score(docs: DataFrame, toks: DataFrame, model: Chain) -> DataFrame:
    """(doc_id, score, sexual, hate, threat, insult) for every row of ``docs``, whose words are in ``toks``.

    ``score`` is the largest probability of abuse over the text's segments, the
    categories likewise; null, empty and wordless texts score 0. Whole texts are
    read. Equal doc_ids share a row.
    """
    # some 2**BITS weights a link, whatever the corpus
    held = docs.sparkSession.sparkContext.broadcast((model.words, model.cues, model.before, model.bias, model.known, model.rare))

    def run(batches):
        for b in batches:
            toks, ids = b.column("toks"), b.column("doc_id")
            sizes = pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False)
            *m, known, rare = held.value
            g = _grams(pc.list_flatten(toks).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes), known)
            if not g.n:
                continue
            seg_doc = g.doc
            p = _predict(*m, _Rows(g, rare))
            starts = np.flatnonzero(np.r_[True, seg_doc[1:] != seg_doc[:-1]])
            top = np.maximum.reduceat(p, starts, axis=0)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(seg_doc[starts])), *[pa.array(top[:, j]) for j in range(len(CHAIN))]], ["doc_id", *CHAIN])

    per = toks.mapInArrow(run, "doc_id bigint, " + ", ".join(f"{c} double" for c in CHAIN))
    every = per.unionByName(docs.select("doc_id", *[F.lit(0.0).alias(c) for c in CHAIN]))
    return every.groupBy("doc_id").agg(F.max(CHAIN[4]).alias("score"), *[F.max(c).alias(c) for c in CHAIN[:4]])


def _scored(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    toks = materialise(tokens(docs), "words")
    model = train(toks, labels)
    return score(docs, toks, model), model.threshold


def abusive_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored, at = _scored(docs, labels)
    return scored.where(F.col("score") >= at)


def abuse_rates(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, documents, abusive, rate) per source; a null source is a source of its own."""
    scored, at = _scored(docs.select("doc_id", "text"), labels)
    s = scored.select("doc_id", (F.col("score") >= at).cast("int").alias("hit"))
    j = docs.select("doc_id", "source").join(s, "doc_id")
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("hit").alias("abusive"), (F.sum("hit") / F.count(F.lit(1))).alias("rate"))
