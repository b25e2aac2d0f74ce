"""Language-model scores of whole texts.

Words are counted over all training documents; a causal self-attention model, trained in numpy, reads their subword ids. Every window
of every training document trains it: documents are dealt into rounds and shards, each task goes on from the last round's weights over
its shard, and the weights are averaged by the symbols behind them. A word's
probability mixes its share of the training tokens with what the attention model gives its subwords in context. The
model reads windows of two blocks of ids: the second block is scored, the first is its context, so windows overlap by one block and each id is scored
once. Attention is computed for thousands of windows at a time under one causal mask.
"""

from __future__ import annotations

import base64
import ctypes
import glob
import os
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import small_batches, staged, without

#: Ids scored in a window, and as many before them as context.
BLOCK = 8
#: The softmax is a choice of class and of a member in it: CLASSES * MEMBERS symbols.
CLASSES, MEMBERS = 32, 64
WIDTH, HEAD, HIDDEN = 24, 16, 32
#: Rounds of training at most, and symbols that one task trains on in a round, about. One of APART documents comes last and fits the mix first.
ROUNDS, SHARD, APART = 8, 1 << 20, 20
#: Texts are dealt out in runs of so many symbols; all runs but a text's first begin with two blocks of context.
RUN, LEAD = 4096 * BLOCK, 2 * BLOCK
#: Mixing weights at which the slope of the likelihood is taken.
MIXES = np.linspace(0.02, 0.98, 193)
#: Windows in one computation, and in one step of its attention: their arrays stay in the processor's cache.
PART, CHUNK = 2048, 512
#: Training steps at least, of so many windows, and the rate they begin with; a large input takes as many steps as its windows need.
STEPS, WINDOWS, RATE = 500, 1536, 0.02
#: At most so many of the most frequent words, of at most so many bytes, whose counts every task holds; the counts of all others are joined.
HEAD_WORDS, HEAD_BYTES = 200_000, 64
#: Symbols: a byte inside a word, a byte that ends a word, the end of a text, then subwords.
END, FIRST_PIECE = 512, 513
_CACHE_WORDS = 300_000
_COUNT_WORDS = 250_000


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode().lower().split() if text else []


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """``words_of`` for a column of texts: the distinct words, the place among them of each word, one text after the other, and the words of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.list_flatten(lists).dictionary_encode()
    words, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    none = pc.index(words, pa.scalar("", words.type)).as_py()  # white space at either end of a text leaves an empty word there
    if none >= 0:
        real = at != none
        lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[real], minlength=len(lengths))
        at = at[real]
        at = at - (at > none)
        words = pa.concat_arrays([words[:none], words[none + 1 :]])
    return words.cast(pa.binary()), at, lengths


def _list(words: pa.Array) -> list[bytes]:
    return words.to_numpy(zero_copy_only=False).tolist()


@lru_cache(maxsize=1)
def _merger(ranks_path: str):
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    raw = {i: t for t, i in ranks.items()}
    core = tiktoken.Encoding("subwords", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
    return core.encode_single_piece, raw


@lru_cache(maxsize=1)
def one_thread() -> None:
    """Keep numpy's linear algebra to the task's own thread: its matrices are too small to be shared out, and threads that wait for work cost as much as ones that do it."""
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), os.pardir, "numpy.libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


@lru_cache(maxsize=1)
def keep_memory() -> None:
    """Let the C library hand freed arrays of up to 32 MB out again: given back and fetched anew at each step, they can cost as much in page faults as the arithmetic on them."""
    library = ctypes.CDLL(None)
    if hasattr(library, "mallopt"):
        library.mallopt(-3, 1 << 25)  # M_MMAP_THRESHOLD
        library.mallopt(-1, 1 << 28)  # M_TRIM_THRESHOLD


def _exp(x: np.ndarray) -> None:
    """exp in place; kept from overflow, which weights this small don't come near."""
    if x.max(initial=0) > 40:
        np.minimum(x, 40, out=x)
    np.exp(x, out=x)


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis as a product: the fastest way for short rows."""
    return x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1], np.float32)


@dataclass
class Model:
    """Weights folded into tables by symbol, and the subwords that are symbols (id * 2 + whether it ends a word)."""

    ranks_path: str
    pieces: dict[int, int]
    tables: dict[str, np.ndarray]
    mix: float = 0.5

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "codes"}

    @cached_property
    def codes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the symbols of every subword, inside and at the end of a word (id * 2 + 1), begin, how many there are, and all of them: itself, or its bytes one by one."""
        raw = _merger(self.ranks_path)[1]
        tokens = [t for i in range(max(raw) + 1) for t in (raw.get(i, b""),) * 2]
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = np.cumsum(sizes)
        flat = np.frombuffer(b"".join(tokens), np.uint8).astype(np.int16)
        flat[ends[1::2][sizes[1::2] > 0] - 1] += 256
        kept = np.fromiter(self.pieces, np.int64, len(self.pieces))
        flat[ends[kept] - sizes[kept]] = np.fromiter(self.pieces.values(), np.int16, len(kept))
        count = sizes.copy()
        count[kept] = 1
        return ends - sizes, count, flat

    def coded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of words one after the other, and how many each has."""
        pieces, sizes = subwords_of(words, self.ranks_path)
        start, count, flat = self.codes
        many = count.take(pieces)
        ends = np.cumsum(many)
        where = start.take(pieces)
        if ends.size and ends[-1] > ends.size:
            where = np.repeat(where - (ends - many), many) + np.arange(ends[-1])
        return flat.take(where), np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])])

    def symbols(self, word: bytes) -> bytes:
        """The word's symbols as bytes of 16-bit numbers."""
        return self.coded([word])[0].tobytes()

    def log_probs(self, blocks: np.ndarray, first: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural logs of the targets' probabilities [n, BLOCK] for blocks of inputs in the order of their texts; ``first`` marks those that begin one."""
        t, n = self.tables, len(blocks)
        ids = np.concatenate([blocks[-1:], blocks])
        h, hot = np.empty((n * BLOCK, HIDDEN), np.float32), np.empty(n * BLOCK, np.float32)
        place = t["place"].take(targets.reshape(-1))
        cls, member = place // MEMBERS, place % MEMBERS
        logits, spots = np.empty((CHUNK * BLOCK, CLASSES), np.float32), np.arange(CHUNK * BLOCK) * CLASSES
        for lo in range(0, n, CHUNK):
            hi = min(n, lo + CHUNK)
            kv = t["kv"].take(ids[lo : hi + 1].reshape(-1), 0)
            # blocks and the ones before them share their rows
            both = np.lib.stride_tricks.as_strided(kv, (hi - lo, 2 * BLOCK, HEAD + HIDDEN), (BLOCK * kv.strides[0], *kv.strides), writeable=False)
            qr = t["qr"].take(blocks[lo:hi], 0)
            s = qr[:, :, :HEAD] @ both[:, :, :HEAD].transpose(0, 2, 1)
            s += t["near"]
            s[first[lo:hi], :, :BLOCK] = -1e9
            _exp(s)
            part = slice(lo * BLOCK, hi * BLOCK)
            o = np.matmul(s, both[:, :, HEAD:], out=h[part].reshape(hi - lo, BLOCK, HIDDEN))
            o /= _sums(s).reshape(hi - lo, BLOCK, 1)
            o += qr[:, :, HEAD:]
            np.maximum(o, 0, out=o)
            y = np.matmul(h[part], t["wc"], out=logits[: len(o) * BLOCK])
            y += t["bc"]
            got = y.reshape(-1).take(spots[: len(y)] + cls[part])
            _exp(y)
            np.subtract(got, np.log(_sums(y)), out=hot[part])
        order = np.argsort(cls.astype(np.uint8), kind="stable")
        ends = np.searchsorted(cls.take(order), np.arange(CLASSES + 1))
        h, member = h.take(order, 0), member.take(order)
        most = int(np.diff(ends).max())
        logits, spots, out = np.empty((most, MEMBERS), np.float32), np.arange(most) * MEMBERS, np.empty(n * BLOCK, np.float32)
        for c in range(CLASSES):
            lo, hi = ends[c], ends[c + 1]
            if hi > lo:
                z = np.matmul(h[lo:hi], t["wm"][c], out=logits[: hi - lo])
                z += t["bm"][c]
                got = z.reshape(-1).take(spots[: hi - lo] + member[lo:hi])
                _exp(z)
                out[order[lo:hi]] = got - np.log(_sums(z))
        out += hot
        return out.reshape(n, BLOCK)


def windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of inputs, marks of first blocks, blocks of targets, and the places of the real targets in these, for texts that end with END."""
    sizes = np.array([len(x) for x in texts])
    blocks = -(-sizes // BLOCK)
    starts = np.concatenate([[0], np.cumsum(blocks)[:-1]]) * BLOCK
    flat = np.concatenate(texts)
    where = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(flat.size)
    n = int(blocks.sum())
    targets, inputs = np.full(n * BLOCK, END, np.int16), np.full(n * BLOCK, END, np.int16)
    targets[where] = flat
    inputs[1:] = targets[:-1]
    inputs[starts] = END
    first = np.zeros(n, bool)
    first[starts // BLOCK] = True
    return inputs.reshape(n, BLOCK), first, targets.reshape(n, BLOCK), where


def _class_order(pairs: np.ndarray) -> np.ndarray:
    """Symbols in an order whose equal runs follow similar symbols: halved again and again by singular vectors of the pair counts."""
    total, rows, cols = pairs.sum() + 1e-9, pairs.sum(1, keepdims=True), pairs.sum(0, keepdims=True)
    score = np.log1p(pairs * total / (rows * cols + 1))
    rng = np.random.default_rng(0)
    basis = rng.normal(size=(len(score), 12))
    for _ in range(4):
        basis, _ = np.linalg.qr(score @ (score.T @ basis))
    places = score.T @ basis
    order = [np.arange(len(score))]
    for axis in range(int(np.log2(CLASSES))):
        order = [half for part in order for half in np.array_split(part[np.argsort(places[part, axis], kind="stable")], 2)]
    return np.concatenate(order)


def bare_model(seen: dict[int, int], ranks_path: str) -> Model:
    """A model without weights whose symbols are the most frequent of the subwords seen."""
    kept = sorted(sorted(seen, key=lambda p: (-seen[p], p))[: CLASSES * MEMBERS - FIRST_PIECE])
    return Model(ranks_path, {p: FIRST_PIECE + n for n, p in enumerate(kept)}, {})


def subwords_of(words: list[bytes], ranks_path: str) -> tuple[np.ndarray, np.ndarray]:
    """The subwords of words one after the other, as id * 2 + whether it ends the word, and how many each word has."""
    ids = list(map(_merger(ranks_path)[0], words))
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    out = 2 * np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum()))
    out[np.cumsum(sizes) - 1] += 1
    return out, sizes


def start(pairs: np.ndarray, seed: int = 7) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """First weights, and the symbols' places in the classes, from counts of pairs (input, target)."""
    size = CLASSES * MEMBERS
    order = _class_order(pairs)
    place = np.empty(size, np.int64)
    place[order] = np.arange(size)
    rng = np.random.default_rng(seed)
    f32 = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    share = pairs.sum(0, dtype=np.float64) + 0.02
    by_class = share[order].reshape(CLASSES, MEMBERS)
    return {
        "e": f32(size, WIDTH, scale=0.5), "wq": f32(WIDTH, HEAD, scale=0.2), "wk": f32(WIDTH, HEAD, scale=0.2), "wv": f32(WIDTH, HIDDEN, scale=0.2),
        "wr": f32(WIDTH, HIDDEN, scale=0.2), "b": np.full(HIDDEN, 0.1, np.float32), "near": np.zeros(2 * BLOCK, np.float32), "wc": f32(HIDDEN, CLASSES, scale=0.1),
        "bc": np.log(by_class.sum(1) / share.sum()).astype(np.float32), "wm": f32(CLASSES, HIDDEN, MEMBERS, scale=0.1), "bm": np.log(by_class / by_class.sum(1, keepdims=True)).astype(np.float32),
    }, place


_GAP = np.arange(BLOCK)[:, None] - (np.arange(2 * BLOCK)[None, :] - BLOCK)
_ROOT = np.float32(HEAD**-0.5)


def fold(p: dict[str, np.ndarray], place: np.ndarray) -> dict[str, np.ndarray]:
    """Weights as tables by symbol."""
    kv, qr = p["e"] @ np.concatenate([p["wk"], p["wv"]], axis=1), p["e"] @ np.concatenate([p["wq"] * _ROOT, p["wr"]], axis=1)
    qr[:, HEAD:] += p["b"]
    return {
        "kv": kv, "qr": qr, "q": qr[:, :HEAD], "k": kv[:, :HEAD], "v": kv[:, HEAD:], "r": qr[:, HEAD:], "wc": p["wc"], "bc": p["bc"], "wm": p["wm"], "bm": p["bm"],
        "near": np.where(_GAP >= 0, p["near"][np.maximum(_GAP, 0)], -1e9).astype(np.float32), "place": place,
    }


def _by_symbol(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the rows of each symbol; ``rows`` ends with a row of zeros more."""
    order = np.argsort(ids, kind="stable")
    ids = ids.take(order)
    cut = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
    sizes = np.diff(cut, append=ids.size)
    # eight rows at a time, filled up with the row of zeros: sums of equal length are far cheaper than of unequal ones
    eights = -(-sizes // 8)
    starts = np.cumsum(eights) - eights
    index = np.full(8 * int(eights.sum()), len(rows) - 1)
    index[np.arange(ids.size) + np.repeat(8 * starts - cut, sizes)] = order
    sums = np.einsum("ijk->ik", rows.take(index, 0).reshape(-1, 8, rows.shape[1]))
    out = np.zeros((CLASSES * MEMBERS, rows.shape[1]), np.float32)
    out[ids[cut]] = sums[starts]
    many = np.flatnonzero(eights > 1)
    if many.size:
        size = eights[many]
        out[ids[cut[many]]] = np.add.reduceat(sums[np.repeat(eights > 1, eights)], np.cumsum(size) - size, axis=0)
    return out


def _gradients(p: dict[str, np.ndarray], t: dict[str, np.ndarray], before: np.ndarray, now: np.ndarray, first: np.ndarray, targets: np.ndarray, real: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean loss over the real targets of windows: blocks of inputs ``now`` and the blocks before them."""
    g, n = {}, len(now)
    ids = np.concatenate([before, now], axis=1)
    kv, qr = t["kv"].take(ids, 0), t["qr"].take(now, 0)
    q, k, v = qr[:, :, :HEAD], kv[:, :, :HEAD], kv[:, :, HEAD:]
    a = q @ k.transpose(0, 2, 1)
    a += t["near"]
    a[first, :, :BLOCK] = -1e9
    _exp(a)
    a *= (1 / _sums(a)).reshape(n, BLOCK, 1)
    z = a @ v
    z += qr[:, :, HEAD:]
    np.maximum(z, 0, out=z)
    z = z.reshape(-1, HIDDEN)
    live = np.flatnonzero(real.reshape(-1))
    spot = t["place"].take(targets.reshape(-1).take(live))
    order = np.argsort((spot // MEMBERS).astype(np.uint8), kind="stable")
    live, spot = live.take(order), spot.take(order)
    cls, member = spot // MEMBERS, spot % MEMBERS
    ends = np.searchsorted(cls, np.arange(CLASSES + 1))
    most = int(np.diff(ends).max(initial=0))
    h, scale, ones = z.take(live, 0), np.float32(1 / max(1, spot.size)), np.ones(max(1, spot.size), np.float32)
    y = h @ p["wc"]
    y += p["bc"]
    _exp(y)
    y *= (scale / _sums(y))[:, None]
    y.reshape(-1)[np.arange(spot.size) * CLASSES + cls] -= scale
    g["wc"], g["bc"] = h.T @ y, ones[: spot.size] @ y
    gh = y @ p["wc"].T
    g["wm"], g["bm"] = np.zeros_like(p["wm"]), np.zeros_like(p["bm"])
    room, at = np.empty((most, MEMBERS), np.float32), np.arange(most) * MEMBERS
    for c in range(CLASSES):
        lo, hi = ends[c], ends[c + 1]
        if hi > lo:
            m = np.matmul(h[lo:hi], p["wm"][c], out=room[: hi - lo])
            m += p["bm"][c]
            _exp(m)
            m *= (scale / _sums(m))[:, None]
            m.reshape(-1)[at[: hi - lo] + member[lo:hi]] -= scale
            np.matmul(h[lo:hi].T, m, out=g["wm"][c])
            np.matmul(ones[: hi - lo], m, out=g["bm"][c])
            gh[lo:hi] += m @ p["wm"][c].T
    gh *= h > 0
    gqr, gkv = np.zeros((n * BLOCK + 1, HEAD + HIDDEN), np.float32), np.empty((2 * n * BLOCK + 1, HEAD + HIDDEN), np.float32)
    gkv[-1] = 0
    gqr[live, HEAD:] = gh
    own, both = gqr[:-1].reshape(n, BLOCK, -1), gkv[:-1].reshape(n, 2 * BLOCK, -1)
    gw = own[:, :, HEAD:]
    ga = gw @ v.transpose(0, 2, 1)
    ga -= _sums(ga * a).reshape(n, BLOCK, 1)
    ga *= a
    np.matmul(ga, k, out=own[:, :, :HEAD])
    np.matmul(ga.transpose(0, 2, 1), q, out=both[:, :, :HEAD])
    np.matmul(a.transpose(0, 2, 1), gw, out=both[:, :, HEAD:])
    g["near"] = np.bincount(np.maximum(_GAP, 0).ravel(), np.where(_GAP >= 0, (np.ones(n, np.float32) @ ga.reshape(n, -1)).reshape(_GAP.shape), 0).ravel(), 2 * BLOCK).astype(np.float32)
    both, own = _by_symbol(ids.reshape(-1), gkv), _by_symbol(now.reshape(-1), gqr)
    own[:, :HEAD] *= _ROOT
    down, up = p["e"].T @ both, p["e"].T @ own
    g["wk"], g["wv"], g["wq"], g["wr"], g["b"] = down[:, :HEAD], down[:, HEAD:], up[:, :HEAD], up[:, HEAD:], own[:, HEAD:].sum(0)
    g["e"] = both @ np.concatenate([p["wk"], p["wv"]], axis=1).T + own @ np.concatenate([p["wq"], p["wr"]], axis=1).T
    return g


def fit(p: dict[str, np.ndarray], place: np.ndarray, texts: list[np.ndarray], leads: list[int], *, steps: int, done: float = 0.0, part: float = 1.0, seed: int = 7) -> int:
    """Go on with weights ``p``, in place, over the symbols of texts (Adam): all windows once, and again while there were under ``steps`` steps.

    The first ``leads`` symbols of a text are context alone. ``done`` and ``part`` are the shares of all training that lie before and in this call. Returns the symbols trained on.
    """
    inputs, first, targets, where = windows(texts)
    lead = np.concatenate([np.arange(len(x)) < n for x, n in zip(texts, leads, strict=True)])
    real = np.zeros(targets.size, bool)
    real[where] = ~lead
    real = real.reshape(targets.shape)
    usable = np.flatnonzero(real.any(1))
    if not usable.size:
        return 0
    one_thread()
    keep_memory()
    steps = max(steps, -(-usable.size // WINDOWS))
    rng = np.random.default_rng(seed)
    # the weights are views of one array, so that a step of Adam is a few operations on all of them
    cuts = np.cumsum([x.size for x in p.values()])[:-1]
    x = np.concatenate([w.reshape(-1) for w in p.values()])
    w = {k: v.reshape(p[k].shape) for k, v in zip(p, np.split(x, cuts), strict=True)}
    m1, m2, room = np.zeros_like(x), np.zeros_like(x), np.empty_like(x)
    deck = np.empty(0, np.int64)
    for step in range(1, steps + 1):
        while deck.size < min(WINDOWS, usable.size):
            deck = np.concatenate([deck, rng.permutation(usable)])
        pick, deck = deck[:WINDOWS], deck[WINDOWS:]
        found = _gradients(w, fold(w, place), inputs.take(pick - 1, 0, mode="wrap"), inputs.take(pick, 0), first.take(pick), targets.take(pick, 0), real.take(pick, 0))
        g = np.concatenate([found[k].reshape(-1) for k in p])
        rate = np.float32(RATE * min(1, step / 20) * (1 - 0.95 * (done + part * step / steps)))
        np.subtract(g, m1, out=room)
        room *= np.float32(0.1)
        m1 += room
        g *= g
        g -= m2
        g *= np.float32(0.01)
        m2 += g
        np.sqrt(m2, out=room)
        room *= np.float32((1 - 0.99**step) ** -0.5)
        room += np.float32(1e-7)
        np.divide(m1, room, out=room)
        room *= rate / np.float32(1 - 0.9**step)
        x -= room
    for k in p:
        p[k][...] = w[k]
    return int(real.sum())


def pair_codes(texts: list[np.ndarray], leads: list[int]) -> np.ndarray:
    """Pairs (input, target) as input * symbols + target."""
    size, codes = CLASSES * MEMBERS, []
    for x, n in zip(texts, leads, strict=True):
        x = x.astype(np.int64)
        codes.append((x[n - 1 : -1] if n else np.concatenate([[END], x[:-1]])) * size + x[n:])
    return np.concatenate(codes)


def count_pairs(texts: list[np.ndarray], leads: list[int]) -> np.ndarray:
    """Counts of pairs (input, target) as a flat array."""
    return np.bincount(pair_codes(texts, leads), minlength=(CLASSES * MEMBERS) ** 2)


def train(texts: list[list[bytes]], ranks_path: str, *, steps: int = STEPS, seed: int = 7) -> Model:
    """Fit the attention model to texts given as words, in this process."""
    seen: Counter[int] = Counter()
    for w, n in Counter(chain.from_iterable(texts)).items():
        for x in subwords_of([w], ranks_path)[0].tolist():
            seen[x] += n
    model = bare_model(seen, ranks_path)
    flat = [np.frombuffer(b"".join([*map(model.symbols, words), np.int16(END).tobytes()]), np.int16) for words in texts] or [np.array([END], np.int16)]
    none = [0] * len(flat)
    p, place = start(count_pairs(flat, none).reshape(CLASSES * MEMBERS, -1).astype(np.float32), seed)
    fit(p, place, flat, none, steps=steps, seed=seed)
    model.tables = fold(p, place)
    return model


def train_on_all(learn: DataFrame, counts: DataFrame, ranks_path: str, mix_of: Callable[[Model, DataFrame], float], *, steps: int = STEPS, seed: int = 7) -> Model:
    """Fit the attention model to every window of every row of ``learn`` (_o, a hash, and _text), whose words ``counts`` (word, c) has.

    Documents are dealt by hash into rounds, and in a round into shards of about SHARD symbols, long texts in runs. Each shard's task
    goes on from the weights of the round before; the mean of their weights, weighted by symbols, is the next round's. One of APART
    documents is left for a last round; before it ``mix_of`` sees these documents and a model that has not.
    """
    spark = learn.sparkSession
    sc = spark.sparkContext
    size = CLASSES * MEMBERS

    def subwords(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for b in batches:
            b = b.filter(pc.greater(pc.binary_length(b.column(0)), 0))
            if b.num_rows:
                pieces, sizes = subwords_of(_list(b.column(0)), ranks_path)
                order = np.argsort(pieces, kind="stable")
                first = np.flatnonzero(np.diff(pieces[order], prepend=-1))
                found = pieces[order[first]]
                if found[-1] >= seen.size:
                    seen = np.concatenate([seen, np.zeros(int(found[-1]) + 1 - seen.size, np.int64)])
                seen[found] += np.add.reduceat(np.repeat(b.column(1).to_numpy(), sizes)[order], first)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["piece", "n"])

    seen = counts.select("word", "c").mapInArrow(subwords, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    model = bare_model({r["piece"]: r["n"] for r in seen.collect()}, ranks_path)  # at most two for each rank
    told = sc.broadcast(model)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(told.value)
        for b in batches:
            words, at, lengths = split_words(b.column(1))
            flat, _, sizes = with_ends(*lexicon.symbols(lexicon.number(_list(words))[at]), lengths)
            data, stops = flat.tobytes(), 2 * np.cumsum(sizes)
            os, parts, leads, runs = [], [], [], []
            for o, lo, hi in zip(b.column(0).to_pylist(), (stops - 2 * sizes).tolist(), stops.tolist(), strict=True):
                for n, start_at in enumerate(range(lo, hi, 2 * RUN)):
                    os.append(o)
                    parts.append(n)
                    leads.append(LEAD if n else 0)
                    runs.append(data[start_at - 2 * leads[-1] : min(hi, start_at + 2 * RUN)])
            yield pa.RecordBatch.from_arrays([pa.array(os, pa.int64()), pa.array(parts, pa.int64()), pa.array(leads, pa.int64()), pa.array(runs, pa.binary())], names=["o", "part", "lead", "ids"])

    runs = staged(learn.select("_o", "_text").mapInArrow(coded, "o long, part long, lead long, ids binary"), "lm-symbols")

    def of(b: pa.RecordBatch) -> tuple[list[np.ndarray], list[int]]:
        return [np.frombuffer(x, np.int16) for x in b.column(b.num_columns - 1).to_pylist()], b.column(b.num_columns - 2).to_pylist()

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held = np.zeros(size * size, np.int64), []
        for b in batches:
            if b.num_rows:
                held.append(pair_codes(*of(b)))
            if sum(map(len, held)) > size * size:  # counted together, as each count walks the whole table
                n += np.bincount(np.concatenate(held), minlength=size * size)
                held = []
        if held:
            n += np.bincount(np.concatenate(held), minlength=size * size)
        code = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n[code])], names=["code", "n"])

    found = runs.select("lead", "ids").mapInArrow(paired, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # at most size * size
    pairs = np.zeros(size * size, np.float32)
    pairs[found.column("code").to_numpy()] = found.column("n").to_numpy()
    p, place = start(pairs.reshape(size, size), seed)
    names, shapes = list(p), [x.shape for x in p.values()]
    cuts = np.cumsum([x.size for x in p.values()])[:-1]
    total = int(pairs.sum(dtype=np.float64))
    apart = F.pmod("o", F.lit(APART)) == 0
    rounds = min(ROUNDS, max(1, total // SHARD))
    turn = F.pmod(F.xxhash64("o"), F.lit(rounds))
    plan = [(runs.where(~apart & (turn == r)), total / rounds, steps // rounds) for r in range(rounds)] + [(runs.where(apart), total / APART, 1)]

    for r, (own, symbols, least) in enumerate(plan):
        if r == rounds:
            model.tables = fold(p, place)
            model.mix = mix_of(model, learn.where(F.pmod("_o", F.lit(APART)) == 0))
        shards = max(1, round(symbols / SHARD))
        sent = sc.broadcast(p)

        def trained(batches: Iterator[pa.RecordBatch], r: int = r, least: int = least, span: float = 1 / len(plan), sent=sent) -> Iterator[pa.RecordBatch]:
            held: dict[int, tuple[list[np.ndarray], list[int]]] = {}
            for b in batches:
                for shard, x, n in zip(b.column(0).to_pylist(), *of(b), strict=True):
                    mine = held.setdefault(shard, ([], []))
                    mine[0].append(x)
                    mine[1].append(n)
            for shard, (texts, leads) in held.items():
                w = {k: x.copy() for k, x in sent.value.items()}
                n = fit(w, place, texts, leads, steps=least, done=r * span, part=span, seed=seed + shard)
                flat = np.concatenate([x.reshape(-1) for x in w.values()]).astype(np.float64) * n
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["n", "w"])

        dealt = own.select(F.pmod(F.xxhash64("o", "part", F.lit(1)), F.lit(shards)).alias("shard"), "o", "part", "lead", "ids")
        dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "o", "part", "ids").select("shard", "lead", "ids")
        sums = dealt.mapInArrow(trained, "n long, w binary").rdd.map(lambda x: (x[0], np.frombuffer(x[1])))
        n, flat = sums.treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1])) if not own.isEmpty() else (0, None)
        if n:
            p = {k: x.reshape(shape).astype(np.float32) for k, x, shape in zip(names, np.split(flat / n, cuts), shapes, strict=True)}
    model.tables = fold(p, place)
    return model


class Lexicon:
    """Numbers for words, with the symbols of each and, if counts are given, its count (-1: not among them); a bounded number is remembered."""

    def __init__(self, model: Model, counts: dict[bytes, int] | None = None):
        self.model, self.counts = model, counts or {}
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat, self.ends, self.known, self.uses = np.empty(0, np.int16), np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def _forget(self) -> None:
        """Keep the words that came up in more than one call, unless they are most of them."""
        kept = np.flatnonzero(self.uses > 1)
        if 2 * kept.size > _CACHE_WORDS:
            self._clear()
            return
        flat, sizes = self.symbols(kept)
        words = list(self.place)
        self.place = {words[i]: n for n, i in enumerate(kept.tolist())}
        self.flat, self.ends, self.known, self.uses = flat, np.concatenate([[0], np.cumsum(sizes)]), self.known[kept], np.ones(kept.size, np.int64)

    def number(self, words: list[bytes]) -> np.ndarray:
        """The numbers of distinct words, good until the next call."""
        find = self.place.get
        out = np.array([find(w, -1) for w in words], np.int64)
        fresh = np.flatnonzero(out < 0)
        if fresh.size and self.place and len(self.place) + fresh.size > _CACHE_WORDS:
            self._forget()
            find = self.place.get
            out = np.array([find(w, -1) for w in words], np.int64)
            fresh = np.flatnonzero(out < 0)
        if fresh.size:
            new = [words[i] for i in fresh.tolist()]
            out[fresh] = np.arange(len(self.place), len(self.place) + len(new))
            self.place.update(zip(new, out[fresh].tolist(), strict=True))
            flat, sizes = self.model.coded(new)
            self.flat = np.concatenate([self.flat, flat])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            self.known = np.concatenate([self.known, np.fromiter((self.counts.get(w, -1) for w in new), np.int64, len(new))])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        self.uses[out] += 1
        return out

    def symbols(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of words one after the other, and how many each has."""
        start, size = self.ends[numbers], self.ends[numbers + 1] - self.ends[numbers]
        total = np.cumsum(size)
        where = np.arange(int(total[-1]) if total.size else 0) + np.repeat(start - np.concatenate([[0], total[:-1]]), size)
        return self.flat[where], size


def with_ends(flat: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols and word sizes of texts of so many words with an END after each text, and the symbols of each text."""
    stops = np.cumsum(lengths)
    before = np.concatenate([[0], np.cumsum(sizes)])[stops]
    return np.insert(flat, before, np.int16(END)), np.insert(sizes, stops, 1), np.diff(np.concatenate([[0], before])) + 1


class Scorer:
    """Log probabilities that the attention model gives the words of texts."""

    def __init__(self, model: Model, counts: dict[bytes, int] | None = None):
        one_thread()
        keep_memory()
        self.model, self.lexicon = model, Lexicon(model, counts)

    def flat(self, words: list[bytes], at: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probabilities of the words and the end of each text, one text after the other, and the counts that the lexicon has for them (ends: 0).

        Texts come as distinct words, the place among them of each word, and the words of each text.
        """
        numbers = self.lexicon.number(words)[at]
        known = np.insert(self.lexicon.known[numbers], np.cumsum(lengths), 0)
        # runs of texts of about so many words at a time, so that windows stay in the processor's cache
        stops, lps, text = np.cumsum(lengths), [], 0
        while text < len(lengths):
            begin = int(stops[text] - lengths[text])
            upto = max(text + 1, int(np.searchsorted(stops, begin + 16_000, "right")))
            lps.append(self._run(*with_ends(*self.lexicon.symbols(numbers[begin : int(stops[upto - 1])]), lengths[text:upto])))
            text = upto
        return np.concatenate(lps or [np.empty(0)]), known

    def tokens(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """For each text the natural log probabilities of its words and of its end."""
        place: dict[bytes, int] = {}
        at = np.array([place.setdefault(w, len(place)) for w in chain.from_iterable(texts)], np.int64)
        lengths = np.array([len(x) for x in texts], np.int64)
        return np.split(self.flat(list(place), at, lengths)[0], np.cumsum(lengths + 1)[:-1]) if texts else []

    def _run(self, symbols: np.ndarray, sizes: np.ndarray, text_sizes: np.ndarray) -> np.ndarray:
        inputs, first, targets, where = windows(np.split(symbols, np.cumsum(text_sizes)[:-1]))
        lp = np.empty(targets.shape, np.float32)
        for lo in range(0, len(inputs), PART):
            # a part begins with the block before it, as context only
            a = max(0, lo - 1)
            lp[lo : lo + PART] = self.model.log_probs(inputs[a : lo + PART], first[a : lo + PART], targets[a : lo + PART])[lo - a :]
        real = lp.reshape(-1)[where].astype(np.float64)
        return np.add.reduceat(real, np.concatenate([[0], np.cumsum(sizes)[:-1]]))


def mix_slopes(u: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Slopes of the log likelihood in the mixing weight at MIXES, for tokens with shares ``u`` and the attention model's probabilities ``a``."""
    return np.array([np.sum((u - a) / (m * u + (1 - m) * a + 1e-300)) for m in MIXES])


def best_mix(slopes: np.ndarray) -> float:
    """The weight of the words' shares that makes the tokens likeliest: the likelihood is concave, so its slope falls through zero once at most."""
    if not slopes.any():
        return 0.5
    if slopes[0] <= 0 or slopes[-1] >= 0:
        return float(MIXES[0] if slopes[0] <= 0 else MIXES[-1])
    i = int(np.flatnonzero(slopes > 0)[-1])
    return float(MIXES[i] + (MIXES[i + 1] - MIXES[i]) * slopes[i] / (slopes[i] - slopes[i + 1]))


def score(docs: DataFrame, ranks_path: str, *, doc_id: str = "doc_id", text: str = "text", steps: int = STEPS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and other columns of every row, repeated rows too.

    Documents with crc32(doc_id as text) mod 10 = 0, and those without an id, are held out; counts and model learn from the
    others. Null and wordless texts are one token, their end. Without training documents every count is 0 and the model knows the bare alphabet.
    Columns named like results are replaced. Empty in, empty out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    added = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    source, keep = docs, without(docs, text, *added)
    # other columns travel under names that clash with none of those used here, and get their own back at the end
    own = [f"other_{i}" for i in range(len(keep))]
    key = F.col(f"`{doc_id}`").cast("string")
    out_mark = F.coalesce(F.pmod(F.crc32(key.cast("binary")), F.lit(10)), F.lit(0)) == 0
    src = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(keep, own, strict=True)], out_mark.alias("held_out"), key.alias("_key"), F.col(f"`{text}`").cast("string").alias("_text"))
    keep = own

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        ends = 0

        def summed() -> pa.RecordBatch:
            if len(held) == 1:
                return held[0]
            t = pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
            return pa.RecordBatch.from_arrays([t.column("word").combine_chunks(), t.column("n_sum").combine_chunks()], names=["word", "n"])

        for b in batches:
            words, at, lengths = split_words(b.column(0))
            held.append(pa.RecordBatch.from_arrays([words, pa.array(np.bincount(at, minlength=len(words)))], names=["word", "n"]))
            ends += len(lengths)
            if sum(x.num_rows for x in held) > _COUNT_WORDS:
                held = [summed()]
                if held[0].num_rows > _COUNT_WORDS // 2:
                    yield held.pop()
        if held:
            yield summed()
        if ends:  # the empty word stands for the ends: no word is empty
            yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([ends], pa.int64())], names=["word", "n"])

    learn = src.where(~F.col("held_out"))
    counts = staged(learn.select("_text").mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the least count of a head word, from word counts by a sixteenth of an octave: a few hundred rows, and no sort of all words; the ends are always among them
    short = counts.where(F.length("word") <= HEAD_BYTES).withColumn("step", F.floor(F.log2("c") * 16))
    room, least = HEAD_WORDS, None
    for r in sorted(short.groupBy("step").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"]):
        if (room := room - r["n"]) < 0:
            break
        least = r["step"]
    frequent = F.lit(False) if least is None else F.col("step") >= least
    top = short.where(frequent | (F.length("word") == 0)).select("word", "c").toArrow()
    head = dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True))
    below = total + 0.1 * (distinct + 1)

    held_head = spark.sparkContext.broadcast(head)

    def mix_of(model: Model, apart: DataFrame) -> float:
        told = spark.sparkContext.broadcast(model)

        def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = held_head.value
            scorer = Scorer(told.value, known)
            for b in batches:
                if b.num_rows:
                    words, at, lengths = split_words(b.column(0))
                    lp, c = scorer.flat(_list(words), at, lengths)
                    c[np.cumsum(lengths + 1) - 1] = known.get(b"", 0)
                    far = words.take(pa.array(np.insert(at, np.cumsum(lengths), 0), mask=c >= 0))
                    yield pa.RecordBatch.from_arrays([far, pa.array(c, pa.int64()), pa.array(lp)], names=["word", "near", "lp"])

        def slopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(len(MIXES))
            for b in batches:
                out += mix_slopes((b.column(0).to_numpy() + 0.1) / below, np.exp(b.column(1).to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], names=["s"])

        rows = staged(apart.select("_text").mapInArrow(tokens, "word binary, near long, lp double"), "lm-mix")
        near = rows.where("word IS NULL").select(F.col("near").alias("c"), "lp")
        far = rows.where("word IS NOT NULL").join(counts, "word", "left").select(F.coalesce("c", F.lit(0)).alias("c"), "lp")
        each = near.unionByName(far).mapInArrow(slopes, "s array<double>").select(F.posexplode("s"))
        return best_mix(np.array([r["s"] for r in each.groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos").collect()]))

    model = train_on_all(learn.select(F.xxhash64("_key", "_text").alias("_o"), "_text"), counts, ranks_path, mix_of, steps=steps)
    shared = spark.sparkContext.broadcast((model, head))  # at most HEAD_WORDS words of HEAD_BYTES bytes, and a model of fixed size
    names = [*keep, "held_out", "_rid", "_word", "_lp", "n_tokens", "_near_known", "_base", "_full"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shared.value
        scorer, mix = Scorer(m, known), m.mix
        for b in batches:
            if not b.num_rows:
                continue
            words, at, lengths = split_words(b.column(b.num_columns - 1))
            rids = b.column(b.num_columns - 2).to_numpy()
            lp, c = scorer.flat(_list(words), at, lengths)
            stops = np.cumsum(lengths + 1)
            c[stops - 1] = known.get(b"", 0)
            near = c >= 0
            share = (np.maximum(c, 0) + 0.1) / below
            full = np.where(near, np.log10(np.where(c > 0, mix * share, 0) + (1 - mix) * np.exp(lp) + 1e-300), 0)
            base = np.where(near, np.log10(share), 0)
            starts = np.concatenate([[0], stops[:-1]])
            figures = [np.diff(np.concatenate([[0], stops])), np.add.reduceat((c > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(full, starts)]
            far = np.flatnonzero(~near)
            of = np.searchsorted(stops, far, "right")
            far_rid, far_lp = rids[of], lp[far]
            far_word = words.take(pa.array(at[far - of]))  # before a text lie the ends of those before it
            n = len(rids)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-2], pa.array(rids, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.float64()), *map(pa.array, figures)], names=names
            )
            if far.size:
                k = len(far_rid)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.nulls(k, c.type) for c in b.columns[:-2]), pa.array(far_rid, pa.int64()), far_word, pa.array(far_lp, pa.float64()), *(pa.nulls(k, pa.int64()),) * 2, *(pa.nulls(k, pa.float64()),) * 2], names=names
                )

    ready = src.select(*[F.col(f"`{c}`") for c in keep], "held_out", F.monotonically_increasing_id().alias("_rid"), "_text")
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema.fields[:-1]] + ["_word binary", "_lp double", "n_tokens long", "_near_known long", "_base double", "_full double"]
    rows = staged(ready.mapInArrow(scored, ", ".join(schema)), "lm-rows")
    c = F.coalesce(F.col("c"), F.lit(0))
    share = (c + 0.1) / F.lit(float(below))
    far = rows.where("_word IS NOT NULL").select("_rid", F.col("_word").alias("word"), "_lp").join(counts, "word", "left").groupBy("_rid").agg(
        F.sum((c > 0).cast("long")).alias("_far_known"), F.sum(F.log10(share)).alias("_far_base"),
        F.sum(F.log10(F.when(c > 0, share * model.mix).otherwise(0.0) + (1 - model.mix) * F.exp("_lp") + F.lit(1e-300))).alias("_far_full"),
    ).withColumnRenamed("_rid", "_far_rid")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return rows.where("_word IS NULL").join(far, F.col("_rid") == F.col("_far_rid"), "left").select(
        *[F.col(o).alias(c) for o, c in zip(own, without(source, text, *added), strict=True)], "held_out", "n_tokens", (F.col("_near_known") + zero("_far_known")).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("_base") + zero("_far_base")).cast("double").alias("base_score"), (F.col("_full") + zero("_far_full")).cast("double").alias("score"),
    )
