"""Texts of the fixtures."""

import random

WORDS = "amber birch cedar delta ember fjord grove heron inlet jetty knoll larch maple north ocean plain quartz river stone tulip".split()


def prose(seed: int, words: int) -> str:
    """Text of random words; two seeds share no long run of words."""
    draw = random.Random(seed)
    made = ("".join(draw.choice("bdfgklmnprst") + draw.choice("aeiou") for _ in range(draw.randint(1, 3))) for _ in range(words))
    return " ".join(draw.choice(WORDS) if draw.random() < 0.2 else w for w in made)


def documents() -> list[tuple]:
    """(doc_id, text): copies, near copies, shared passages, odd rows, a repeated row and a long text."""
    base, passage = prose(1, 120), prose(2, 60)
    edited = base.split()
    edited[60] = "changed"
    shared_line = "A line that several documents repeat, with Ümlaut"
    rows = [
        (1, base), (2, base), (3, " ".join(edited)), (4, prose(3, 80)),
        (5, prose(4, 30) + "\n" + passage + "\n" + prose(5, 30)),
        (6, prose(6, 20) + "\n" + passage + "\n" + prose(7, 20)),
        (7, None), (8, ""), (9, "   \t \n "), (10, "two words"), (11, "Two WORDS"), (12, "one"),
        (13, f"  {shared_line}\t\nown line of this document\nshort"), (14, f"{shared_line.upper().replace('Ü', 'Ü')}\nshort\n\n"),
        (15, "na " * 300), (16, prose(8, 3000)), (17, prose(9, 50)), (17, prose(9, 50)), (18, "日本 é 'ß' 7 <|x|> " * 30),
        (19, shared_line), (20, prose(10, 100) + " " + prose(8, 3000)[:500]),
    ]
    return rows
