"""Awkward rows: null id, null text, blank, very long, repeated, equal and near texts, control strings."""

LONG = " ".join(f"word{k % 700} and{k}" for k in range(30_000))
PASSAGE = "\n".join(" ".join(f"passage{i}x{j}" for j in range(20)) for i in range(4))
NEAR = " ".join(f"near{k}" for k in range(60))

ROWS = [
    (1, "the quick brown fox"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, LONG),
    (6, LONG),
    (7, LONG + " and one more"),
    (8, f"first own line\n{PASSAGE}\nlast own line"),
    (9, f"other own line\n\n{PASSAGE}\nanother"),
    (10, NEAR),
    (11, NEAR.replace("near30 ", "")),
    (12, "x"),
    (12, "x"),
    (12, "y"),
    (None, "the quick  brown fox"),
    (None, None),
    (13, "Ünïcode 😀 <|endoftext|>it's </s>\x1cok"),
]
