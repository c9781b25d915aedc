import random
import re

from kvspark.llm.chat import LEAST_CHARS, link_quotes

SCHEMA = "conv_id long, turn long, role string, text string, row int, hash int, depth int"


def run(spark, rows):
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    got = link_quotes(frame).collect()
    assert len(got) == len(rows)
    return {(r.conv_id, r.turn): r for r in got}


def test_nested_quotes_link_to_their_originals(spark):
    got = run(spark, [
        (1, 0, "user", "Where is the old library?\n\nI looked everywhere today."),
        (1, 1, "assistant", "It is behind the market square."),
        (1, 2, "user", "A different question about trains."),
        (1, 3, "assistant", "> It is behind the market square.\n> > Where is the OLD library?\n\nOpen until nine."),
        (1, 4, "user", ">> it is behind  the market square\n>Open until nine!\nThanks."),
        (1, 5, "user", "> Nobody ever said this sentence.\nReally?"),
        (1, 6, "user", "> A different question about trains.\nYes."),
    ])
    assert got[1, 3].parent_turn == 1 and got[1, 3].n_quotes == 2 and got[1, 3].n_linked == 2
    assert got[1, 3].text == "Open until nine."
    assert got[1, 4].parent_turn == 3 and got[1, 4].text == "Thanks." and got[1, 4].thread_turn == 1
    assert got[1, 5].parent_turn is None and got[1, 5].thread_turn == 5 and (got[1, 5].n_quotes, got[1, 5].n_linked) == (1, 0)
    assert got[1, 6].parent_turn == 2 and got[1, 6].thread_turn == 2
    order = [r.turn for r in sorted(got.values(), key=lambda r: r.position)]
    assert order == [0, 1, 3, 4, 2, 6, 5] and sorted(r.position for r in got.values()) == list(range(7))


def test_part_of_a_message_and_first_of_equals(spark):
    got = run(spark, [
        (1, 0, "a", "First line here.\nSecond line here."),
        (1, 1, "a", "Second line here."),
        (1, 2, "b", "> Second line here.\nOk."),
        (2, 0, "b", "> Second line here.\nOther conversation."),
        (2, 1, "b", "> Other conversation.\n> Second line here."),
    ])
    assert got[1, 2].parent_turn == 0
    assert got[2, 0].parent_turn is None
    # A run that is quoted in part links by its lines, and a quote alone leaves no text.
    assert got[2, 1].parent_turn == 0 and got[2, 1].text == ""


def test_short_passages_link_to_the_earliest_that_says_them(spark):
    got = run(spark, [
        (1, 0, "a", "Why?"), (1, 1, "b", "> why\nBecause."), (1, 2, "a", "Yes."), (1, 3, "b", "No.\nYes."),
        (1, 4, "a", "> Yes.\nWhich of them?"), (1, 5, "a", "我不知道这事"), (1, 6, "b", "> 我不知道这事。\nok"),
        (1, 7, "b", "> Nobody said it.\n> Why?\nok"), (1, 8, "b", "> Why?"), (1, 9, "b", "Why?"), (1, 10, "b", "> ?!"),
    ])
    assert {k[1]: r.parent_turn for k, r in got.items() if r.n_quotes} == {1: 0, 4: 2, 6: 5, 7: 0, 8: 0, 10: None}
    assert [got[1, k].n_linked for k in (1, 4, 6, 7, 8, 10)] == [1, 1, 1, 1, 1, 0]


def test_long_chain_of_replies(spark):
    rows = [(1, 0, "u", "message number zero begins")]
    for i in range(1, 40):
        before = f"message number {i - 1} goes on" if i > 1 else "message number zero begins"
        rows.append((1, i, "u", f"> {before}\nmessage number {i} goes on"))
    got = run(spark, rows)
    assert all(got[1, i].thread_turn == 0 and got[1, i].parent_turn == i - 1 for i in range(1, 40))


def test_awkward_messages(spark):
    rows = [
        (1, 0, "u", None), (1, 1, None, ""), (1, 2, "u", ">"), (1, 3, "u", "> > >"), (None, 4, "u", "some words of a message"),
        (None, 5, "u", "> some words of a message"), (1, None, "u", "> some words of a message"), (1, 6, "u", "a > b and x >> y"),
        (1, 7, "u", "> " + "long words " * 5000), (1, 9, "u", "> " * 20000 + "deep"), (1, 8, "u", "line\r\n> line\r\n"), (3, 0, "u", "twice said words"), (3, 0, "u", "twice said words"),
        (3, 1, "u", "> twice said words\nyes"),
    ]
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    got = link_quotes(frame).collect()
    assert len(got) == len(rows)
    assert {r.text for r in got if r.turn == 6} == {"a > b and x >> y"}
    assert [(r.parent_turn, r.n_linked) for r in got if (r.conv_id, r.turn) == (3, 1)] == [(0, 1)]
    assert all(r.parent_turn is None for r in got if r.conv_id is None or r.turn is None)
    assert link_quotes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([(1, 0, "u", "> a", 1, 2, 3)], SCHEMA)
    plan = link_quotes(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute(rows):
    """(text, n_quotes, n_linked, parent, thread) of every message, one at a time."""

    def units(parts):
        norm = [re.sub(r"[\W_]+", "", p.lower()) for p in parts]
        return {n for n in norm if len(n) >= LEAST_CHARS}

    parsed, said = [], {}
    for conv, turn, _, text in rows:
        lines = []
        for line in (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
            marks = re.match(r"[ \t]*>[> \t]*", line)
            lines.append((marks.group().count(">") if marks else 0, line[marks.end() :] if marks else line))
        runs = []
        for depth, line in lines:
            joins = runs and runs[-1][0] == depth and line.strip(" ") and runs[-1][1].strip(" ")
            if joins:
                runs[-1][1] += "\n" + line
            else:
                runs.append([depth, line])
        runs = [r for r in runs if r[1].strip(" ")]
        own = [line for depth, line in lines if depth == 0]
        body = re.sub(r"\n[ \t]*(\n[ \t]*)+", "\n\n", "\n".join(own)).strip()
        quotes = [(d, units([t, *t.split("\n")])) for d, t in runs if d]
        parsed.append((conv, turn, body, quotes))
        for u in units(["\n".join(own), *(t for d, t in runs if d == 0), *own]):
            said[conv, u] = min(turn, said.get((conv, u), turn))
    parent, out = {}, []  # turns are distinct here, see the test of shared turns
    for conv, turn, body, quotes in parsed:
        found = [(d, said[conv, u], k) for k, (d, us) in enumerate(quotes) for u in us if said.get((conv, u), turn) < turn]
        up = max(((-d, t) for d, t, _ in found), default=(0, None))[1]
        out.append([conv, turn, body, len(quotes), len({k for _, _, k in found}), up])
        if up is not None:
            parent[conv, turn] = min(up, parent.get((conv, turn), up))
    for row in out:
        top = row[1]
        while (row[0], top) in parent:
            top = parent[row[0], top]
        row.append(top)
    for conv in {row[0] for row in out}:
        for position, row in enumerate(sorted((r for r in out if r[0] == conv), key=lambda r: (r[-1], r[1]))):
            row.append(position)
    return sorted(map(tuple, out))


def test_random_conversations_follow_brute_force(spark):
    rng = random.Random(0)
    rows = []
    for conv in range(25):
        bodies = []
        for turn in range(rng.randrange(1, 14)):
            parts = []
            for _ in range(rng.randrange(3)):
                if bodies:
                    quoted = rng.choice(bodies)
                    if rng.random() < 0.5:
                        quoted = rng.choice(quoted.split("\n"))
                    mark = "> " * rng.randrange(1, 4)
                    parts += [mark + (line.upper() if rng.random() < 0.2 else line) for line in quoted.split("\n")]
            own = [" ".join(f"word{rng.randrange(60)}" for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 4))]
            bodies.append("\n".join(own))
            parts += own if rng.random() < 0.8 else ["", *own, "", "tail of it"]
            rows.append((conv, turn, "u", "\n".join(parts)))
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    got = sorted(
        (r.conv_id, r.turn, r.text, r.n_quotes, r.n_linked, r.parent_turn, r.thread_turn, r.position) for r in link_quotes(frame).collect()
    )
    assert [g[:3] for g in got] == [w[:3] for w in brute(rows)]
    assert got == brute(rows)


def test_messages_that_share_a_turn_have_their_own_parents(spark):
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in [
        (1, 0, "a", "The first thing."), (1, 1, "b", "Another thing."), (1, 2, "c", "> The first thing.\nyes one"),
        (1, 2, "d", "> Another thing.\nyes two"), (1, 3, "a", "> yes two\nfine"), (None, None, "x", "a"), (None, 3, "x", "b"),
    ]], SCHEMA)
    got = {(r.conv_id, r.turn, r.role): (r.parent_turn, r.thread_turn, r.position) for r in link_quotes(frame).collect()}
    assert got[1, 2, "c"] == (0, 0, 1) and got[1, 2, "d"] == (1, 1, 3) and got[1, 3, "a"] == (2, 1, 4)
    assert got[1, 0, "a"] == (None, 0, 0) and got[1, 1, "b"] == (None, 1, 2)
    assert got[None, None, "x"] == (None, None, 0) and got[None, 3, "x"] == (None, 3, 1)
