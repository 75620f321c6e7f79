"""Language models learn from every training text."""

import zlib

import numpy as np

from waymark.llm import language_id


def test_every_training_text_counts(spark):
    """Each of 3,000 texts of one language has a word of its own; those of ids that neither are held out nor calibrate are all in the model."""
    names = ["".join(chr(ord("a") + (k // 26**j) % 26) for j in range(3)) for k in range(3000)]
    docs = spark.createDataFrame([(k, f"q{n}", "xx", "s", 4) for k, n in enumerate(names)], "doc_id long, text string, lang string, source string, n_chars long")
    model = language_id.train(docs)
    counts = {r["doc_id"] for r in language_id.trainable(docs).where("not calibrates").collect()}
    assert len(counts) > 1000 and all(zlib.crc32(str(k).encode()) % 3 != 1 for k in counts)
    packed = np.concatenate([language_id.grams([f"q{names[k]}"])[0][-1:] for k in sorted(counts)])
    assert language_id.find(model["gram"][3], language_id.hashed(packed, 4))[1].all()


def test_confidence_counts_rows():
    margin, right = np.array([0.1, 0.1, 0.1, 0.5, 0.5]), np.array([0.0, 1.0, 1.0, 1.0, 1.0])
    some = language_id.fit_confidence(np.array([0.1, 0.1, 0.5]), np.array([0.0, 1.0, 1.0]), np.array([1.0, 2.0, 2.0]))
    assert np.allclose(language_id.fit_confidence(margin, right), some)
