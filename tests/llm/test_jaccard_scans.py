"""The Jaccard join over an input whose row order differs from scan to scan."""

import random

from barloom.llm import jaccard


def test_equal_texts_meet_whatever_the_blocks(spark):
    def unordered(batches):
        """The rows in another order each time they are read."""
        import random

        import pyarrow as pa

        rows = [r for b in batches for r in b.to_pylist()]
        random.SystemRandom().shuffle(rows)
        for i in range(0, len(rows), 20):
            part = rows[i : i + 20]
            yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in part], pa.int64()), pa.array([r["text"] for r in part], pa.string())], names=["doc_id", "text"])

    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(4000)) for _ in range(30)]
    rows = [(i, texts[i % 30]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).mapInArrow(unordered, "doc_id long, text string")
    assert sum(len(t) for _, t in rows) > 4 * jaccard.CHUNK_BYTES
    assert {r.doc_id: r.component_id for r in jaccard.join(docs).collect()} == {i: i % 30 for i in range(600)}
