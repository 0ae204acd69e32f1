"""Texts that tests share."""

import random

ODD = ["a  b", "É́ x’s", "naïve  don't ﬁ", "ΑΣ ΟΔΟΣ", "\x1c a\x85b\u00a0c", "日本語 テスト😀👩‍👩‍👧", "İstanbul", "  \n\n x", "á b é", "<|endoftext|> it's", "\u0000\u0001"]


def sentence(seed: int, n: int = 120) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))
