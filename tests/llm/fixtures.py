"""A small corpus with exact and near copies, shared passages, long, empty and null texts, ties and repeated rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, score double"


def words(rnd: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed: int = 5) -> list[tuple]:
    rnd = random.Random(seed)
    passage, texts = words(rnd, 70), []
    for i in range(30):
        w = words(rnd, rnd.randint(1, 160))
        if i % 4 == 0:
            cut = rnd.randint(0, len(w))
            w = w[:cut] + passage[: rnd.choice([45, 55, 70])] + w[cut:]
        texts.append(" ".join(w))
    base = words(rnd, 120)
    for _ in range(6):
        near = list(base)
        near[rnd.randrange(120)] = "edited"
        texts.append(" ".join(near))
    texts += [texts[3], texts[3], " ".join(["same"] * 300), "", None, None, "\x0b \t", "é日本 \U0001f600  x y", "no-space" * 400, "a b c"]
    rows = [(i * 3, t, "en", "src", None if t is None else len(t), 1, "k", 0.5) for i, t in enumerate(texts)]
    rows.append(rows[4])  # a repeated row
    rows.append((None, "nobody knows my number", None, None, None, None, None, None))
    rnd.shuffle(rows)
    return rows
