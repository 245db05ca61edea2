"""Small tables with the hard cases: nulls, empty and long texts, ties, repeats, odd characters."""

from __future__ import annotations

import random

ALPHABET = "the of and to in is that it was for on are as with his they be at one have this from".split()


def prose(rng: random.Random, n: int) -> str:
    words = [rng.choice(ALPHABET) + rng.choice(["", "", "s", "ing", "x" * rng.randint(1, 6)]) for _ in range(n)]
    return " ".join(words)


def texts(seed: int = 7) -> list[str | None]:
    """Texts in doc_id order, with copies, near copies, shared passages, and shapes that break pieces."""
    rng = random.Random(seed)
    base = [prose(rng, n) for n in (80, 120, 200, 60, 150)]
    passage = prose(rng, 40)
    footer = "Shared footer line of the site, with more than forty characters."
    near = []
    for i in range(12):
        words = base[1].split()
        words[rng.randrange(len(words))] = f"changed{i}"
        near.append(" ".join(words))
    out: list[str | None] = [
        None, "", " ", "\n", "\n\n\n", "one", "one two three", "four words are here", "five words are in here",
        base[0], base[0], base[0].upper(), base[1], *near, base[2], base[2] + " tail",
        f"{passage}\n{base[3]}", f"{base[4]}\n{passage}", f"x{passage}y", passage, passage,
        "a" * 350, "ab" * 200, "a" * 99, "a" * 100, "a" * 101,
        "  two  spaces \n and \n\n lines ", "tab\tand\x0bvertical\x0cfeed\r\nreturn", "\x1c\x1d\x00nul",
        "don't can't we're they've I'll you'd it's 's 're", "<|endoftext|>", "a<|endoftext|> b <|endoftext",
        "<|startoftext|>x<|endoftext|>", "Straße ÉCLAIR élan İstanbul Σίσυφος", "é ö ﬁ", "日本語 の文 書",
        "emoji 😀👍🏽 end", " nbsp em　wide", "word" * 700, "!?" * 800, "9" * 1200,
        " ".join([prose(rng, 6) + "!"] * 30), "### *** $$$ | | <> && %", prose(rng, 3000),
    ]
    for i in range(7):
        out.append(f"{prose(rng, 30)}\n{footer if i % 2 else '  ' + footer.upper() + '  '}\n{prose(rng, 25)}\n")
    rng.shuffle(out)
    return out


def rows(seed: int = 7) -> list[tuple[int, str | None]]:
    return [(3 * i - 40, t) for i, t in enumerate(texts(seed))]


def documents(spark, data, extra: bool = True):
    """A documents table; with further columns whose names clash with those the operators make."""
    schema = "doc_id BIGINT, text STRING, source STRING"
    full = [(d, t, None if i % 11 == 0 else "hot" if i % 3 else f"src{i % 5}") for i, (d, t) in enumerate(data)]
    df = spark.createDataFrame(full, schema).repartition(3)
    if extra:
        for name in ("n_words", "kept", "content", "n_tokens", "key", "label", "place", "score", "n_lines"):
            df = df.selectExpr("*", f"'clash' AS {name}")
    return df
