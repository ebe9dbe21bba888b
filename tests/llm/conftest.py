import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, a long, b long, _id long, block int, share int, h long"


def rows_of(texts, langs=None, sources=None):
    """Rows of ``documents`` with further columns whose names operators use inside."""
    out = []
    for k, (doc_id, text) in enumerate(texts):
        lang = langs[k] if langs else "en"
        source = sources[k] if sources else "s"
        out.append((doc_id, text, lang, source, len(text or ""), 0.5, 1, 2, 3, 4, 5, 6))
    return out


@pytest.fixture(scope="session")
def documents(spark):
    def make(texts, **more):
        return spark.createDataFrame(rows_of(texts, **more), SCHEMA)

    return make


WORDS = [f"w{k}" for k in range(400)] + ["Ça", "straße", "日本", "naïve"]


@pytest.fixture(scope="session")
def prose():
    """Texts with copies, near copies, shared passages, null, blank and long ones."""
    draw = random.Random(5)

    def text(n):
        return "".join(draw.choice(WORDS) + draw.choice([" ", " ", " ", "\n", "\t"]) for _ in range(n))

    texts = [text(draw.choice([1, 2, 3, 30, 80, 150])) for _ in range(60)]
    passage = text(70)
    texts += [text(40) + passage + text(30) for _ in range(6)] + [passage, passage]
    for base in texts[:12]:
        words = base.split(" ")
        for edits in (0, 1, 3):
            copy = list(words)
            for _ in range(edits):
                copy[draw.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    hub = text(150).split()
    for _ in range(60):  # a group around one text: some pairs are similar, others are not
        copy = list(hub)
        for _ in range(draw.randrange(6)):
            copy[draw.randrange(len(copy))] = draw.choice(WORDS)
        texts.append(" ".join(copy))
    texts += ["", "   \n\t ", None, "x" * 300_000, "long " * 30_000, text(20_000)]
    draw.shuffle(texts)
    return [(7 * k % 1009, t) for k, t in enumerate(texts)]
