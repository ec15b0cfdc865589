"""HTML extraction: a bidirectional LSTM in numpy labels every leaf block of a page as article text or not.

A leaf's vector holds its path of open elements (tags and class, id and role words,
hashed, the innermost ones once more), its words (hashed, by share), its length,
link share and place. One LSTM reads the page's leaves forwards, one backwards, so each
decision sees the whole page; a logistic layer on both states gives the label.

Training pages are a bounded sample (about ``train_pages``, by the crc32 of page_id, of up to ``train_bytes`` bytes), read whole. Their
labels come from the elements that state their purpose (article, main; nav, aside,
footer, form ...). Copies of the sample with renamed containers and foreign blocks
put in under the usual class words teach pages that are built another way. Text is never a
clue for the inserted blocks: it is borrowed from other blocks.

Defined results: null or empty html, and pages without article blocks, have an empty text;
no training page at all leaves the stated-purpose labels in place; repeated pages are
read each; pages of any length are read whole; a block of probability 0.5 is left out. Other input columns are not
read, so names can't clash but for the columns a caller keeps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subseg.llm import words as W
from subseg.llm.html_blocks import Leaf, leaf_blocks

PATH_DIM, LAST_DIM, WORD_DIM, EXTRA = 96, 32, 32, 5
INPUT = PATH_DIM + LAST_DIM + WORD_DIM + EXTRA
HIDDEN = 24
SLICE = 2 << 20
JOIN = "\n\n"

MAIN = frozenset(("article", "main", ".main", ".article"))
#: elements and class words of blocks that aren't the article (fixed values)
ASIDE_TAGS = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "noscript", "head", "title", "fieldset", "select", "button")
ASIDE_WORDS = (
    "ad ads advert advertisement banner breadcrumb breadcrumbs bottom comment comments consent cookie cookies copyright disclaimer "
    "discussion footer gdpr header hidden legal login masthead menu modal nav navbar navigation newsletter notice pagination popup "
    "promo promoted recommended related replies respond search share sharing sidebar signup social sponsor sponsored subscribe tags "
    "teaser toolbar topbar trending widget"
).split()
ASIDE = frozenset(ASIDE_TAGS) | frozenset("." + w for w in ASIDE_WORDS)
#: containers that may stand for an article, a menu, a footer (training copies only)
LIKE_ARTICLE = (
    ("main",), ("div", ".content"), ("div", ".post", ".body"), ("div", ".entry", ".content"), ("section", ".story"), ("div", ".main"),
    ("div", ".article", ".body"), ("main", "article"), ("div", ".page", ".content"), ("div", ".text"), ("section", ".article"), ("div", "article"),
)
LIKE_MENU = (("div", ".menu"), ("ul", ".nav"), ("div", ".navbar"), ("header", "nav"), ("header", "div"), ("div", ".navigation"), ("div", ".header"))
LIKE_FOOTER = (("div", ".footer"), ("div", ".copyright"), ("section", ".bottom"), ("footer", "div"), ("div", ".legal"))


def stated_label(path: tuple[str, ...]) -> bool:
    return not MAIN.isdisjoint(path) and ASIDE.isdisjoint(path)


@lru_cache(1 << 14)
def path_vector(path: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(PATH_DIM + LAST_DIM, np.float32)
    for t in set(path):
        h = zlib.crc32(t.encode())
        out[h % PATH_DIM] += 1.0 if h >> 16 & 1 else -1.0
    for t in path[-3:]:
        h = zlib.crc32(b"last " + t.encode())
        out[PATH_DIM + h % LAST_DIM] += 1.0 if h >> 16 & 1 else -1.0
    return out


def text_vectors(leaves: list[Leaf]) -> np.ndarray:
    """Hashed word shares, log length and link share of each leaf."""
    out = np.zeros((len(leaves), WORD_DIM + 2), np.float32)
    if leaves:
        w = W.words_of(pa.array([x.text for x in leaves], pa.large_string()), lower=True)
        n = np.maximum(np.diff(w.woff), 1)
        slot = w.doc * WORD_DIM + (w.hash % W.U(WORD_DIM)).astype(np.int64)
        out[:, :WORD_DIM] = np.bincount(slot, minlength=len(leaves) * WORD_DIM).reshape(-1, WORD_DIM) / n[:, None]
        out[:, WORD_DIM] = np.log1p(n) / 5
        out[:, WORD_DIM + 1] = [x.linked / max(len(x.text), 1) for x in leaves]
    return out


def vectors(paths: list[tuple[str, ...]], texts: np.ndarray) -> np.ndarray:
    n = len(paths)
    out = np.empty((n, INPUT), np.float32)
    place = np.arange(n) / max(n, 1)
    for i, p in enumerate(paths):
        out[i, : PATH_DIM + LAST_DIM] = path_vector(p)
    out[:, PATH_DIM + LAST_DIM : -3] = texts
    out[:, -3], out[:, -2] = place, 1 - place
    out[:, -1] = min(n, 200) / 200
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class BiLstm:
    """Weights: input and recurrent matrices and bias of either direction, output layer."""

    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 3) -> BiLstm:
        rng = np.random.default_rng(seed)
        p: dict[str, np.ndarray] = {}
        for d in "fb":
            p["x" + d] = rng.normal(0, 0.1, (INPUT, 4 * HIDDEN))
            p["h" + d] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            p["b" + d] = np.zeros(4 * HIDDEN)
            p["b" + d][HIDDEN : 2 * HIDDEN] = 1.0  # remember at first
        p["o"] = rng.normal(0, 0.1, (2 * HIDDEN, 1))
        p["c"] = np.zeros(1)
        return cls(p)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """Hidden states (T, B, H); padding leaves the state as it is."""
        steps, batch, _ = x.shape
        z_in = x @ self.p["x" + d] + self.p["b" + d]
        h, c = np.zeros((batch, HIDDEN), z_in.dtype), np.zeros((batch, HIDDEN), z_in.dtype)
        out = np.empty((steps, batch, HIDDEN), z_in.dtype)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = z_in[t] + h @ self.p["h" + d]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tc, m))
            h, c = np.where(m, o * tc, h), np.where(m, c_new, c)
            out[t] = h
        return out

    def _back(self, x: np.ndarray, d: str, keep: list, dout: np.ndarray, grad: dict) -> None:
        batch = x.shape[1]
        dh, dc = np.zeros((batch, HIDDEN)), np.zeros((batch, HIDDEN))
        dz_all = np.zeros((x.shape[0], batch, 4 * HIDDEN))
        for t, h, c, i, f, o, g, tc, m in reversed(keep):
            dh = dh + dout[t]
            live_h, live_c = np.where(m, dh, 0), np.where(m, dc, 0)
            do = live_h * tc
            dct = live_c + live_h * o * (1 - tc * tc)
            dz = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), do * o * (1 - o), dct * i * (1 - g * g)], axis=1)
            dz_all[t] = dz
            grad["h" + d] += h.T @ dz
            dh = np.where(m, 0, dh) + dz @ self.p["h" + d].T
            dc = np.where(m, dct * f, dc)
        grad["x" + d] += np.tensordot(x, dz_all, ([0, 1], [0, 1]))
        grad["b" + d] += dz_all.sum(axis=(0, 1))

    def probability(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(T, B) probabilities for padded input (T, B, INPUT)."""
        both = np.concatenate([self._run(x, mask, d, None) for d in "fb"], axis=2)
        return _sigmoid(both @ self.p["o"] + self.p["c"])[:, :, 0]

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        keep: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(x, mask, d, keep[d]) for d in "fb"], axis=2)
        e = np.where(mask, _sigmoid(both @ self.p["o"] + self.p["c"])[:, :, 0] - y, 0.0) / mask.sum()
        grad["o"] += np.tensordot(both, e[:, :, None], ([0, 1], [0, 1]))
        grad["c"] += e.sum()
        dboth = e[:, :, None] * self.p["o"][:, 0]
        for k, d in enumerate("fb"):
            self._back(x, d, keep[d], dboth[:, :, k * HIDDEN : (k + 1) * HIDDEN], grad)
        return grad

    def small(self) -> BiLstm:
        return BiLstm({k: v.astype(np.float32) for k, v in self.p.items()})


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), INPUT), np.float32)
    mask = np.zeros((steps, len(pages)), bool)
    for b, p in enumerate(pages):
        x[: len(p), b] = p
        mask[: len(p), b] = True
    return x, mask


def _renamed(path: tuple[str, ...], names: dict[str, tuple[str, ...]]) -> tuple[str, ...]:
    return tuple(x for t in path for x in names.get(t, (t,)))


def altered(paths: list, texts: np.ndarray, labels: np.ndarray, pool: np.ndarray, rng) -> tuple[list, np.ndarray, np.ndarray]:
    """A page built another way: containers renamed, foreign blocks put in."""
    pick = lambda options: options[int(rng.integers(len(options)))]
    word = lambda: "." + pick(ASIDE_WORDS)
    names = {}
    if rng.random() < 0.7:
        names["article"] = pick(LIKE_ARTICLE)
    if rng.random() < 0.6:
        names["nav"] = pick(LIKE_MENU)
    if rng.random() < 0.6:
        names["footer"] = pick(LIKE_FOOTER)
    for t in {t for p in paths for t in p if t.startswith(".") and t in ASIDE}:
        names[t] = (word(),)
    rows = [(_renamed(p, names), t, y) for p, t, y in zip(paths, texts, labels, strict=True)]
    inside = next((p for p, _, y in rows if y), ("html", "body", "div"))
    for _ in range(int(rng.integers(0, 5))):
        container = (pick(("div", "section", "aside", "form", "footer", "header", "nav", "ul", "div", "div")), *((word(),) if rng.random() < 0.85 else ()))
        if len(container) == 1 and container[0] not in ASIDE_TAGS:
            container = ("div", word())
        at = int(rng.integers(0, len(rows) + 1))
        nested = 0 < at < len(rows) and rows[at - 1][2] and rows[at][2]
        base = inside[:-1] if nested or rng.random() < 0.2 else ("html", "body") if rng.random() < 0.6 else ("html", "body", "div", ".page")
        kind = pick(("p", "li", "div", "span", "h3", "td"))
        rows[at:at] = [(base + container + ((kind,) if kind != "span" else ()), pool[int(rng.integers(len(pool)))], 0.0) for _ in range(int(rng.integers(1, 5)))]
    return [r[0] for r in rows], np.stack([r[1] for r in rows]), np.array([r[2] for r in rows])


def train(pages: list[str], epochs: int = 8, copies: int = 2, batch: int = 32, cells: int = 8192, seed: int = 5) -> BiLstm | None:
    """A labeller fitted to the stated labels of whole ``pages`` and to altered copies; a batch has up to ``batch`` pages of like length, ``cells`` leaves with padding or one page."""
    rng = np.random.default_rng(seed)
    plain = []
    for page in pages:
        leaves = leaf_blocks(page)
        if leaves:
            plain.append(([x.path for x in leaves], text_vectors(leaves), np.array([float(stated_label(x.path)) for x in leaves])))
    if not any(y.any() for _, _, y in plain):
        return None
    pool = np.concatenate([t for _, t, _ in plain])
    model = BiLstm.fresh(seed)
    first, second, step = {k: np.zeros_like(v) for k, v in model.p.items()}, {k: np.zeros_like(v) for k, v in model.p.items()}, 0
    for epoch in range(epochs):
        rows = [(vectors(p, t), y) for p, t, y in plain]
        for _ in range(copies):
            rows += [(vectors(p, t), y) for p, t, y in (altered(*r, pool, rng) for r in plain)]
        rows.sort(key=lambda r: len(r[1]))
        cuts = [0]
        for i, (_, y) in enumerate(rows):
            if i - cuts[-1] == batch or (i > cuts[-1] and len(y) * (i + 1 - cuts[-1]) > cells):
                cuts.append(i)
        cuts.append(len(rows))
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        for i in rng.permutation(len(cuts) - 1):
            part = rows[cuts[i] : cuts[i + 1]]
            x, mask = padded([r[0] for r in part])
            y = np.zeros(mask.shape)
            for b, r in enumerate(part):
                y[: len(r[1]), b] = r[1]
            step += 1
            for k, g in model.gradient(x.astype(np.float64), mask, y).items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model.small()


def label_pages(model: BiLstm | None, pages: list[list[Leaf]], cells: int = 8192) -> list[np.ndarray]:
    """A label for each leaf of each page; pages of like length share a batch."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    full = [i for i in range(len(pages)) if pages[i]]
    if model is None:
        for i in full:
            out[i] = np.array([stated_label(x.path) for x in pages[i]])
        return out
    texts = text_vectors([x for i in full for x in pages[i]])
    at = dict(zip(full, np.cumsum([0] + [len(pages[i]) for i in full])[:-1], strict=True)) if full else {}
    full.sort(key=lambda i: len(pages[i]))
    while full:
        take = 1
        while take < len(full) and len(pages[full[take]]) * (take + 1) <= cells:
            take += 1
        now, full = full[:take], full[take:]
        x, mask = padded([vectors([x.path for x in pages[i]], texts[at[i] : at[i] + len(pages[i])]) for i in now])
        p = model.probability(x, mask)
        for b, i in enumerate(now):
            out[i] = p[: len(pages[i]), b] > 0.5
    return out


def train_on(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", train_pages: int = 400, train_bytes: int = 1 << 20, **kw) -> BiLstm | None:
    """The labeller of a table. Its bounded sample: whole pages of up to ``train_bytes`` bytes with the smallest hashes of their ids, ``train_pages`` on average."""
    page_id, page = F.col(f"`{id_col}`"), F.col(f"`{html_col}`")
    n = pages.select(page_id).count()
    # ids whose crc32 lies below a bound that the count of pages sets: as many on average, whatever the size
    below = min(1 << 32, (1 << 32) * train_pages // max(n, 1))
    some = pages.where(page_id.isNotNull() & (F.crc32(page_id.cast("string")) < below)).select(page_id.alias("id"), page.alias("html")).where(f"html <> '' and octet_length(html) <= {train_bytes}")
    sample = some.groupBy("id").agg(F.min("html").alias("html")).orderBy("id").collect()
    return train([r["html"] for r in sample if r["html"]], **kw) if sample else None


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",), model: BiLstm | None = None, **kw) -> DataFrame:
    """(page_id, kept columns, text) of every page; the article's blocks joined by an empty line."""
    model = model or train_on(pages, id_col, html_col, **kw)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # some hundred KB
    narrow = pages.select(F.col(f"`{id_col}`").alias("page_id"), *[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in W.slices(batch, "__html", SLICE):
                part = batch.slice(lo, hi - lo)
                leaves = [leaf_blocks(x or "") for x in part.column(part.num_columns - 1).to_pylist()]
                labels = label_pages(shared.value, leaves)
                text = [JOIN.join(x.text for x, y in zip(page, label, strict=True) if y) for page, label in zip(leaves, labels, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(text, pa.string())], names=[*part.schema.names[:-1], "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]) + ", text string"
    return narrow.mapInArrow(run, schema)
