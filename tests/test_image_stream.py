"""An image folder as a stream: several micro-batches, one of them lost and replayed, against the batch run."""

from __future__ import annotations

import os

import numpy as np
import pytest

from curatrix.sources import images as im
from curatrix.streaming import images as st
from tests.test_pixels_and_sources import png


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def add(root, name, content):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(content)


def test_stream_equals_batch(spark, tmp_path):
    root, sink, checkpoint = (f"{tmp_path}/{n}" for n in ("files", "sink", "checkpoint"))
    rng = np.random.default_rng(3)
    for i in range(7):
        add(root, f"{('Train', 'Test')[i % 2]}/{('Fake', 'Real')[i % 3 == 0]}/im{i}.png", png(rng.integers(0, 256, (20 + i, 30, 3))))
    add(root, "Test/Real/broken.png", b"this is no image")
    add(root, "Test/Real/note.txt", b"not listed")
    calls = []

    def fails_in_its_second_batch(images):
        calls.append(images)
        out = st.image_features(images)
        if len(calls) == 2:  # rows are written, but the batch is not committed
            out.write.parquet(f"{sink}/batch=00000001")
            raise RuntimeError("lost")
        return out

    with pytest.raises(Exception):
        st.stream_features(spark, root, sink, checkpoint, 3, fails_in_its_second_batch).awaitTermination()
    assert len(calls) == 2 and spark.read.parquet(sink).count() == 6
    st.stream_features(spark, root, sink, checkpoint, 3).awaitTermination()
    want = rows(st.image_features(im.scan_images(spark, root)))
    assert len(want) == 8 and rows(st.read_features(spark, sink)) == want
    assert spark.read.parquet(sink).select("batch").distinct().count() == 3

    # Later files come by themselves; without new ones nothing is written.
    add(root, "Validation/Fake/late.png", png(rng.integers(0, 256, (9, 9, 3))))
    for _ in range(2):
        st.stream_features(spark, root, sink, checkpoint, 3).awaitTermination()
    assert rows(st.read_features(spark, sink)) == rows(st.image_features(im.scan_images(spark, root)))
