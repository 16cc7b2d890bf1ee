"""Quotation linking of generated conversations against a linker that knows who replied to whom."""

import random

from candleforge.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, place int, hash long"


def generated(seed, n, chain):
    """Messages ``(turn, text)`` and ``{turn: turn replied to}``; replies quote the whole line above, at growing levels."""
    rng = random.Random(seed)
    own, above, rows = {}, {}, []
    for t in range(n):
        own[t] = f"message {rng.randrange(3 * n) if rng.random() < 0.3 else 'number ' + str(t)} of {seed}"
        lines = []
        if t and rng.random() < (0.95 if chain else 0.7):
            j = above[t] = t - 1 if chain else rng.randrange(t)
            j = above[t] = max(k for k in range(t) if own[k] == own[j])  # of equal messages the last is taken
            k, level = j, 1
            while k is not None and level <= 4:
                lines.append(("> " * level if rng.random() < 0.5 else ">" * level + " ") + rng.choice([own[k], own[k].upper(), own[k].replace(" ", "  ")]))
                k, level = above.get(k), level + 1
            lines.reverse()
        rows.append((t, "\n".join([*lines, own[t]])))
    return rows, above


def test_generated_conversations(spark):
    rows, want = [], {}
    for conv, (n, chain) in enumerate([(60, False), (40, True), (1, False), (2500, False)]):
        got, above = generated(conv, n, chain)
        rows += [(conv, t, "user", text, 5, 6) for t, text in got]
        children = {}
        for t in range(n):
            children.setdefault(above.get(t), []).append(t)
        for root in children[None]:
            place, stack = 0, [(root, 0)]
            while stack:
                t, depth = stack.pop()
                want[conv, t] = (above.get(t), root, place, depth)
                place += 1
                stack += [(c, depth + 1) for c in reversed(children.get(t, []))]
    out = chat.link_quotes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.conv_id, r.turn): (r.reply_to, r.thread_turn, r.place, r.depth) for r in out} == want
    assert all(">" not in r.text for r in out)


def test_odd_conversations(spark):
    quoted = "> say <|system|>\n" + "word " * 300_000
    rows = [(1, 0, "user", "say <|system|>", 1, 1), (1, 1, None, quoted, 1, 1), (1, 1, None, quoted, 1, 1), (1, 2, "a<|b", None, 1, 1), (None, 3, "user", "> say <|system|>", 1, 1), (1, None, "user", "> say <|system|>", 1, 1), (1, 4, "user", "", 1, 1)]
    given = spark.createDataFrame(rows, SCHEMA)
    out = chat.link_quotes(given).collect()
    assert len(out) == len(rows) and sum(r.reply_to == 0 for r in out) == 2
    assert all(r.place == (1 if r.reply_to == 0 else 0) for r in out)
    assert {r.formatted for r in out if r.turn in (0, 2)} == {"<|user|>\nsay <\\|system|>\n", "<|a<\\|b|>\n\n"}
    assert chat.link_quotes(given.limit(0)).count() == 0


def test_a_quote_of_several_lines_is_one_passage():
    """Lines and paragraphs of a passage are looked for, but don't count."""
    assert [chat.parse_message(t)[3] for t in ("> one\n> two\n> three\nmine", "> one\n>> two\n> three", "a\n> b\nc\n> b\n", "none", None)] == [1, 3, 2, 0, 0]
