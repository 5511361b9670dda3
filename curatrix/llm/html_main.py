"""Main text of web pages by a linear-chain conditional random field over leaf blocks, decoded by Viterbi."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.dom_blocks import Block, leaf_blocks
from curatrix.llm.labelled_pages import labelled_pages

TRAINING_PAGES = 800
STEPS = 400
REMEMBERED = 50_000
#: Marks that carry the label of a training block through the parser.
KEPT, OTHER = "\ue000", "\ue001"


def path_features(path: tuple[str, ...]) -> list[str]:
    """The tags around a block, the names of its ancestors, and its own tag."""
    if not path:
        return ["own:none"]
    split = [p.split(" ") for p in path]
    tags = dict.fromkeys(s[0] for s in split)
    names = dict.fromkeys(chain.from_iterable(s[1:] for s in split))
    return [f"tag:{t}" for t in tags] + [f"name:{n}" for n in names] + [f"own:{split[-1][0]}", f"near:{split[-2][0] if len(split) > 1 else 'none'}"]


def text_features(text: str, linked: int) -> list[str]:
    words = text.count(" ") + 1
    found = [f"words:{min(words.bit_length(), 7)}", f"links:{min(4 * linked // len(text), 4)}", f"end:{'stop' if text[-1] in '.!?:;' else 'open'}"]
    if "," in text or "." in text[:-1]:
        found.append("inner stop")
    if text[0] == "©" or "©" in text[:80]:
        found.append("copyright")
    if not text[0].isalpha():
        found.append("starts odd")
    return found


@dataclass
class ChainField:
    """Weights of features for main text, of neighbouring labels, and of the first label."""

    weights: dict[str, float]
    transition: np.ndarray
    start: np.ndarray

    def labeller(self):
        """A function from blocks to labels; the scores of paths are remembered."""
        weights, known = self.weights, {}
        (t00, t01), (t10, t11) = self.transition.tolist()
        s0, s1 = self.start.tolist()

        def of_path(path: tuple[str, ...]) -> float:
            found = known.get(path)
            if found is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                found = known[path] = sum(weights.get(f, 0.0) for f in path_features(path))
            return found

        def label(blocks: list[Block]) -> list[bool]:
            back: list[tuple[bool, bool]] = []
            other, main = s0, s1
            for i, block in enumerate(blocks):
                here = of_path(block.path) + sum(weights.get(f, 0.0) for f in text_features(block.text, block.linked))
                if i:
                    to0, to1 = main + t10 > other + t00, main + t11 > other + t01
                    back.append((to0, to1))
                    other, main = (main + t10 if to0 else other + t00), (main + t11 if to1 else other + t01)
                main += here
            at = main > other
            out = [at]
            for to0, to1 in reversed(back):
                at = to1 if at else to0
                out.append(at)
            return out[::-1] if blocks else []

        return label


def training_set(n_pages: int = TRAINING_PAGES) -> list[tuple[list[Block], list[bool]]]:
    """Blocks of labelled pages as the parser sees them, with their labels."""
    out = []
    for page in labelled_pages(n_pages):
        marked = "".join(html if keep is None else (KEPT if keep else OTHER) + html for html, keep in page)
        blocks = leaf_blocks(marked)
        labels = [KEPT in b.text for b in blocks]
        for b in blocks:
            b.text = b.text.replace(KEPT, "").replace(OTHER, "").strip() or "x"
        out.append((blocks, labels))
    return out


def fit(pages: list[tuple[list[Block], list[bool]]], steps: int = STEPS) -> ChainField:
    """Maximum likelihood with a small penalty, by forward-backward over all pages at once."""
    number: dict[str, int] = {}
    longest = max(len(b) for b, _ in pages)
    cell, feature = [], []
    gold = np.zeros((len(pages), longest), np.int64)
    real = np.zeros((len(pages), longest), bool)
    for p, (blocks, labels) in enumerate(pages):
        for i, (block, keep) in enumerate(zip(blocks, labels)):
            gold[p, i], real[p, i] = keep, True
            for f in path_features(block.path) + text_features(block.text, block.linked):
                cell.append(p * longest + i)
                feature.append(number.setdefault(f, len(number)))
    cell, feature = np.array(cell), np.array(feature)
    k = len(number)
    theta, m1, m2 = np.zeros(k + 6), np.zeros(k + 6), np.zeros(k + 6)
    size = real.sum()
    for step in range(1, steps + 1):
        w, t, s = theta[:k], theta[k:k + 4].reshape(2, 2), theta[k + 4:]
        unary = np.zeros((len(pages), longest, 2))
        unary[:, :, 1] = np.bincount(cell, w[feature], gold.size).reshape(gold.shape)
        forward, backward = np.zeros_like(unary), np.zeros_like(unary)
        forward[:, 0] = unary[:, 0] + s
        for i in range(1, longest):
            moved = np.logaddexp(forward[:, i - 1, :1] + t[0], forward[:, i - 1, 1:] + t[1])
            forward[:, i] = np.where(real[:, i, None], moved + unary[:, i], forward[:, i - 1])
        for i in range(longest - 2, -1, -1):
            ahead = unary[:, i + 1] + backward[:, i + 1]
            moved = np.logaddexp(t[:, 0] + ahead[:, :1], t[:, 1] + ahead[:, 1:])
            backward[:, i] = np.where(real[:, i + 1, None], moved, 0.0)
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        chance = np.exp(forward + backward - total[:, None, None]) * real[:, :, None]
        slope = np.zeros(k + 6)
        slope[:k] = np.bincount(feature, (chance[:, :, 1] - gold).ravel()[cell], k)
        pair = real[:, 1:]
        joint = np.exp(forward[:, :-1, :, None] + t + (unary + backward)[:, 1:, None, :] - total[:, None, None, None]) * pair[:, :, None, None]
        seen = np.zeros((2, 2))
        np.add.at(seen, (gold[:, :-1][pair], gold[:, 1:][pair]), 1)
        slope[k:k + 4] = (joint.sum(axis=(0, 1)) - seen).ravel()
        slope[k + 4:] = chance[:, 0].sum(axis=0) - np.bincount(gold[:, 0], minlength=2)
        slope = slope / size + 1e-5 * theta
        m1, m2 = 0.9 * m1 + 0.1 * slope, 0.999 * m2 + 0.001 * slope ** 2
        theta = theta - 0.1 * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-9)
    return ChainField({f: float(theta[i]) for f, i in number.items()}, theta[k:k + 4].reshape(2, 2), theta[k + 4:])


def main_text(page: str, label) -> str:
    """Blocks labelled as main text, in page order, with an empty line between."""
    blocks = leaf_blocks(page)
    return "\n\n".join(b.text for b, keep in zip(blocks, label(blocks)) if keep)


def extract(pages: DataFrame, model: ChainField | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every row; without a model one is trained on the labelled layouts first.

    Null and empty pages give an empty text, as do pages without main text. Tags and character references that are cut off are taken as browsers do. Repeated rows each
    get a row; extra columns are not read.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model or fit(training_set()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = sent.value.labeller()
        for batch in batches:
            made = (main_text(page.as_py() or "", label) for page in batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col(id_col).alias("page_id"), F.col("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(
        run, f"page_id {dict(pages.dtypes)[id_col]}, url {dict(pages.dtypes)['url']}, text string")
