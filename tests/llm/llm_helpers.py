import random

ID_TEXT = "doc_id long, text string, lang string, source string, n_chars long"
# Columns that the operators use as names of their own.
CLASHING = ["score", "leaks", "k0", "tag", "d", "ranges", "key", "n_tokens", "shard", "row",
            "kept", "g0", "t", "component_id", "whole text", "verdict", "host"]


def words(seed: int, n: int, vocabulary: int = 4000) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def sorted_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
