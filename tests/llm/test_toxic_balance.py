"""The toxicity classifier at any ratio of the classes in its sample, and by language."""

import zlib

import numpy as np
import pyarrow.dataset as ds
import pytest

from sievemill.llm import classify


def labelled(n):
    path = "/root/testdata/check_l"
    labels = ds.dataset(f"{path}/labels.parquet").to_table(columns=["doc_id", "toxic"], filter=ds.field("toxic").is_valid()).to_pandas().drop_duplicates("doc_id").sort_values("doc_id")
    parts = [labels[labels["toxic"] == y][:n] for y in (0, 1)]
    texts = ds.dataset(f"{path}/documents.parquet").to_table(columns=["doc_id", "text", "lang"], filter=ds.field("doc_id").isin([*parts[0]["doc_id"], *parts[1]["doc_id"]])).to_pandas()
    return texts.dropna(subset="text").merge(labels, on="doc_id").rename(columns={"toxic": "y"}).sort_values(["doc_id", "text"]).drop_duplicates("text", ignore_index=True)


def test_toxic_languages():
    rows = labelled(3000)
    held = np.array([zlib.crc32(str(k).encode()) % 5 == 0 for k in rows["doc_id"]])
    learn = rows[~held].reset_index(drop=True)
    learn.attrs["prior"] = 0.1
    scorer, tested = classify.fit_toxic(learn), rows[held]
    predicted, toxic = (scorer.score(tested["text"]) >= classify.TOXIC_THRESHOLD).to_numpy(), (tested["y"] == 1).to_numpy()
    for lang in ("en", "de", "fr", "es"):
        own = (tested["lang"] == lang).to_numpy()
        recall, precision = predicted[own & toxic].mean(), toxic[own & predicted].mean()
        assert recall >= 0.85 and precision >= 0.95, (lang, recall, precision)


def test_dictionaries_are_trained_on_the_classes_texts():
    rows = labelled(300)
    rows.attrs["prior"] = 0.1
    toxic, ordinary, shared = classify.fit_toxic(rows).dictionaries
    assert len(toxic) == len(ordinary) and len(shared) <= classify.SHARED
    for some, y in ((toxic, 1), (ordinary, 0)):  # pieces of the class's own lower-cased text
        text = b" ".join(b"".join(classify._windows(t, 1 << 40)) for t in rows[rows["y"] == y]["text"])
        assert sum(some[k : k + 16] in text for k in range(1000, len(some), 101)) > 50
    word = classify._CODES[b"stupid"]
    assert word in toxic and word not in ordinary + shared


@pytest.mark.parametrize("ordinary", [1.0, 0.5])
def test_held_out_accuracy_of_balanced_samples(ordinary):
    rows = labelled(1500)
    held = np.arange(len(rows)) % 3 == 0
    learn = rows[~held]
    n = int((learn["y"] == 1).sum())
    learn = learn[(learn["y"] == 1) | ((learn["y"] == 0).cumsum() <= n * ordinary)].reset_index(drop=True)
    learn.attrs["prior"] = 0.1
    scorer = classify.fit_toxic(learn)
    predicted = scorer.score(rows[held]["text"]) >= classify.TOXIC_THRESHOLD
    right = predicted.to_numpy() == (rows[held]["y"] == 1).to_numpy()
    assert right.mean() >= 0.97
