"""Dictionaries are trained on whole texts."""

import zstandard

from sievemill.llm import classify


def test_parts_cover_whole_texts(monkeypatch):
    seen = []

    def refuse(size, parts):
        seen.extend(parts)
        raise zstandard.ZstdError("too few")

    monkeypatch.setattr(zstandard, "train_dictionary", refuse)
    text = b"".join(b"%07d " % k for k in range(7000))
    held = classify._trained([text])
    assert b"".join(seen) == text
    assert held.replace(b" ", b"") == text.replace(b" ", b"")  # it has room for all
    many = classify._trained([bytes([65 + k]) * 50_000 for k in range(4)])
    assert len(many) <= classify.DICTIONARY and all(many.count(65 + k) > 15_000 for k in range(4))
