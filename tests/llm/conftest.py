from __future__ import annotations

import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars int, "
          # Columns that operators use as names of their own.
          "raw string, fp string, component_id string, n_words string, host string, doc string, keys string, w string, ids string, score string, _host string, _text string")


def edge_rows() -> list[tuple]:
    """Nulls, empty and very long texts, ties and repeated rows, shared passages and lines."""
    draw = random.Random(3)
    vocabulary = ["".join(draw.choices("abcdefghéñß", k=draw.randint(1, 7))) for _ in range(400)]

    def prose(n):
        return " ".join(draw.choices(vocabulary, k=n))

    passage, line = prose(60), "Subscribe to our letter, it is free | of charge"
    texts = [
        None, "", "   \n\t ", "one", "one two", "same same same same " * 30, "a " * 400, "same same same same " * 30, prose(30_000),
        prose(80), prose(80) + "\n\n" + passage, passage.upper(), passage + " " + prose(20), "x\n" * 100, "日本語 テキスト " * 40, "ab\x1ccd\x85ef\xa0gh 　 z" * 20,
        "!!! ??? ...", "12345678901234567890 token = \"0641917ea4e9feb9cda83477b57ac2654884f485\" end", "é" * 3000, " " * 5000]
    near = prose(300)
    texts += [near, near + " tail", near.replace(vocabulary[0], vocabulary[1], 1), near]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, prose(70) + "\n" + line + "\n" + prose(20) + ("\n" + line if i % 3 == 0 else "")) for i in range(12)]
    rows += [(9, texts[9]), (9, texts[9]), (1, "")]  # repeated rows
    out = []
    for k, (i, text) in enumerate(rows):
        host = None if i in (3, 9) else "bad" if i < 9 else "good"
        out.append((i, text, "en", host, None if text is None else len(text), *["clash"] * 12))
    out.append((None, prose(60), None, None, None, *[None] * 12))
    draw.shuffle(out)
    return out


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
