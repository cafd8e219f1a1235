import random

from skein.llm import chat
from skein.llm.queries import ORACLES, QUERIES

from .. import oracle

ROWS = [
    (1, 0, "user", "Hello there.\nHow are you today?"), (1, 1, "assistant", "I am fine.\n\nWhat else?"), (1, 2, "user", "> How are you  TODAY?\nstill asking"),
    (1, 3, "assistant", "So:\n> > How are you today?\n> still asking\nanswer now"), (1, 4, "user", "> unknown words\nhm"), (1, 5, "user", "plain"),
    (2, 0, "user", None), (None, None, None, None), (3, 1, "user", "> later\nquoting ahead"), (3, 2, "user", "later"), (4, 0, "user", "dup"), (4, 0, "user", "dup"),
]
SCHEMA = "conv_id long, turn long, role string, text string, uid string, position int, body string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "u", 1, "b") for r in rows], SCHEMA)


def test_query_equals_sql(spark, sf_dir):
    oracle.compare(spark, QUERIES["op9_chat_format"], ORACLES["op9_chat_format"], sf_dir)


def test_repeated_turns_go_by_role_and_text(spark):
    rows = [(1, 5, "user", "b"), (1, 5, "user", "a"), (1, 5, "assistant", "c"), (1, 4, "user", "z")]
    orders = [[(r.turn, r.role, r.text) for r in chat.thread(table(spark, x).coalesce(1)).orderBy("position").collect()] for x in (rows, rows[::-1])]
    assert orders[0] == orders[1] and [x[1] for x in orders[0]] == ["user", "assistant", "user", "user"]


def test_threads(spark):
    got = {}
    for r in chat.thread(table(spark, ROWS).repartition(3)).orderBy("conv_id", "position").collect():
        got.setdefault(r.conv_id, []).append((r.turn, r.text, r.reply_to, r.n_quotes))
    assert got[1] == [
        (0, "Hello there.\nHow are you today?", None, 0), (2, "still asking", 0, 1), (3, "So:\nanswer now", 2, 2),
        (1, "I am fine.\n\nWhat else?", None, 0), (4, "> unknown words\nhm", None, 0), (5, "plain", None, 0),
    ]
    assert got[2] == [(0, "", None, 0)] and got[None] == [(None, "", None, 0)]
    # nothing can be quoted before it is written
    assert got[3] == [(1, "> later\nquoting ahead", None, 0), (2, "later", None, 0)]
    assert [x[1] for x in got[4]] == ["dup", "dup"]


def test_format_and_chunks(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(10)]
    got = chat.format_chats(table(spark, rows), chunk=4).orderBy("chunk").collect()
    assert [(r.chunk, r.n_messages) for r in got] == [(0, 4), (1, 4), (2, 2)]
    assert got[2].conversation == "<|user|>\nm8\n<|end|>\n<|assistant|>\nm9\n<|end|>"
    assert chat.format_chats(table(spark, rows).limit(0)).count() == 0


def test_only_known_lines_of_a_quotation_go(spark):
    strange = [f"a line {k} that nobody here has written" for k in range(9)]
    rows = [
        (1, 0, "user", "Hi,\nfirst words of one"), (1, 1, "assistant", "second words, longer, of another\nand more"),
        (1, 2, "user", "> Hi,\n" + "\n".join("> " + x for x in strange) + "\nmy answer"),
        (1, 3, "user", "> first words of one\n> second words, longer, of another\n> unheard of\nboth"),
        (1, 4, "user", "> second words, longer,\n> of another and more\n>\n> new\nwrapped"),
    ]
    got = {r.turn: (r.text, r.reply_to, r.n_quotes) for r in chat.thread(table(spark, rows)).collect()}
    assert got[2] == ("\n".join("> " + x for x in strange) + "\nmy answer", None, 0)
    assert got[3] == ("> unheard of\nboth", 1, 1)
    assert got[4] == ("> \n> new\nwrapped", 1, 1)


def brute_parent(rows, i):
    """First message of the conversation that wrote the words of the first quoted line at the lowest level."""
    conv, turn, _, text = rows[i]
    lines = [(len(x) - len(x.lstrip(">")), x.lstrip("> ").strip().lower()) for x in text.split("\n")]
    quotes = sorted((level, k, body) for k, (level, body) in enumerate(lines) if level)
    for _, _, body in quotes:
        own = [r[1] for r in rows if r[0] == conv and r[1] < turn and body in [x.lower() for x in r[3].split("\n") if not x.startswith(">")]]
        if own:
            return min(own)
    return None


def test_links_equal_brute_force(spark):
    r = random.Random(6)
    rows = []
    for conv in range(12):
        for turn in range(9):
            lines = [f"line {conv} {turn} {k}" for k in range(2)]
            if turn and r.random() < 0.6:
                source = r.choice([x for x in rows if x[0] == conv])
                quoted = r.choice([x for x in source[3].split("\n") if not x.startswith(">")])
                lines.insert(0, ">" * r.randint(1, 2) + " " + quoted.upper())
            rows.append((conv, turn, "user", "\n".join(lines)))
    want = {(x[0], x[1]): brute_parent(rows, i) for i, x in enumerate(rows)}
    got = chat.thread(table(spark, rows)).collect()
    assert {(x.conv_id, x.turn): x.reply_to for x in got} == want
    assert all(">" not in x.text for x in got)
    place = {(x.conv_id, x.turn): x.position for x in got}
    assert all(place[c, p] < place[c, t] for (c, t), p in want.items() if p is not None)
    for conv in range(12):
        assert sorted(p for (c, _), p in place.items() if c == conv) == list(range(9))


def test_a_hot_conversation_with_one_line_over_and_over(spark):
    rows = [(1, i, "user", "same line" if i % 2 == 0 else "> same line\nyes") for i in range(400)] + [(2, i, "user", "same line") for i in range(50)]
    got = chat.thread(table(spark, rows)).collect()
    assert len(got) == 450 and {x.reply_to for x in got if x.n_quotes} == {0}


def test_all_chat_rows_are_kept(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = chat.format_chats(df)
    assert got.agg({"n_messages": "sum"}).first()[0] == df.count()
    assert got.count() == df.select("conv_id").distinct().count()
