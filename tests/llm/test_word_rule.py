import random

import pytest
from llm_cases import frame, prose

from keyloom.llm import quality_rules as q


def text(seed, words, share):
    """Prose whose words are common ones with probability ``share``; the others never are."""
    r = random.Random(seed)
    rest = [w for w in prose(seed, 40 * words).split() if w not in q.COMMON["en"] and len(w) > 3]
    return " ".join(r.choice(q.COMMON["en"]) if r.random() < share else w for w in rest[:words])


@pytest.mark.parametrize("share, length", [(0.25, 150), (0.1, 400)])
def test_plain_junk_is_far_by_words(spark, share, length):
    texts = [(i, text(i, length + i % 50, share), "s") for i in range(120)]
    texts += [(500 + i, text(500 + i, length + 30, share / 30), "s") for i in range(8)] + [(600, text(600, length, 0), "s")]
    rows = {r.doc.doc_id: r for r in q.judge(frame(spark, texts)).collect()}
    assert all(rows[i].kept for i in range(120))
    bad = [rows[i] for i in (*range(500, 508), 600)]
    assert not any(r.base_failed for r in bad) and all(r.char_distance <= q.CHAR_LIMIT for r in bad)
    assert not any(r.kept for r in bad) and all(r.word_distance < 0.375 for r in bad)


def test_texts_too_short_for_their_language_are_left_to_the_other_rules(spark):
    texts = [(i, text(i, 110, 0.05), "s") for i in range(60)]
    assert all(r.kept and r.word_distance == 0 for r in q.judge(frame(spark, texts)).collect())
