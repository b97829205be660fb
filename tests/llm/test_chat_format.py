import functools
import hashlib
import random

from tillmark.llm import chat_format as c


def brute(rows):
    """Digests from whole conversations, without any windows."""
    found = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in own))
        turns = [(role, text) for _, _, role, text in own]
        learned = "".join(t for role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{text}\n" for role, text in turns)
        found[conv] = (
            len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned),
            hashlib.sha256(learned.encode()).hexdigest(), len(c.inst_template(turns)), 0,
        )
    return found


def run(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place long, piece string")
    return {r[0]: tuple(r)[1:] for r in c.digests(c.formatted_turns(df)).collect()}


HARD = ["", "</s>", "\\</s>", "\\\\[INST]", "[/INST]\n", "\n</s>\n", "a\\", "[INST]\n", "<s>\n", "\\n", "[ROLE]x\n", "", "\n", "日本\n[/SYS]\n"]


def test_texts_survive():
    random.seed(3)
    for _ in range(2000):
        turns = []
        for _ in range(random.randrange(1, 6)):
            role = random.choice(["user", "assistant", "system", "tool", "", "a\nb\\", "[/ROLE]", "x\\n"])
            turns.append((role, "".join(random.choices(HARD + ["word"], k=random.randrange(4)))))
        assert c.read(c.inst_template(turns)) == turns
        for _, text in turns:
            assert c.unescape(c.escape(text)) == text


def test_like_whole_conversations(spark):
    random.seed(5)
    rows = []
    for conv in [None, -1, 0, 1, 2]:
        for turn in range(60 if conv == 1 else 5):
            role = random.choice(["user", "assistant", "system", "tool", None])
            rows.append((conv, turn if turn != 3 else None, role, random.choice([None, *HARD]), 7, "mine"))
    rows += [rows[0], rows[0], (9, 0, "assistant", "x " * 300_000, 1, "y"), (9, 0, "assistant", "tie", 1, "y")]
    assert run(spark, rows) == brute([r[:4] for r in rows])
    assert run(spark, rows[:0]) == {}


def test_spans_add_up(spark):
    rows = [(4, i, ["user", "assistant"][i % 2], f"[INST] {i} </s>", 0, "") for i in range(50)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place long, piece string")
    turns = sorted(c.formatted_turns(df).collect(), key=lambda r: r.place)
    assert "".join(t.piece for t in turns) == c.inst_template([(r[2], r[3]) for r in rows])
    assert [c.unescape(t.piece[t.text_start : t.text_end]) for t in turns] == [r[3] for r in rows]


def only_last_thought(turns):
    """Drops what earlier answers thought: rewrites history."""
    last = max((i for i, (role, _) in enumerate(turns) if role == "assistant"), default=-1)
    shown = [(r, t if i == last else t.split("</think>")[-1]) for i, (r, t) in enumerate(turns)]
    return "".join(f"<{r}>{t}</{r}>" for r, t in shown)


def test_rewriting_is_seen():
    prefixes = c.Prefixes(only_last_thought)
    turns = [("user", "a"), ("assistant", "hm</think>b"), ("user", "c"), ("assistant", "so</think>d"), ("user", "e")]
    out, replaced = "", []
    for turn in turns:
        piece, start, end, gone = prefixes.add(*turn)
        out = out[: len(out) - gone] + piece
        replaced.append(gone > 0)
    assert out == only_last_thought(turns)
    assert replaced == [False, False, False, True, False]


def test_templates_that_strip_or_hide():
    def strips(turns):
        return "BEGIN " + "".join(f"{r}: {t.strip()}\n" for r, t in turns)

    piece, start, end, gone = c.Prefixes(strips).add("user", "  hello ")
    assert piece == "BEGIN user: hello\n" and piece[start:end] == "hello" and gone == 0
    assert c.Prefixes(lambda turns: "x" * len(turns)).add("user", "hello")[1] is None


def test_work_is_linear():
    calls = []

    def counting(turns):
        calls.append(len(turns))
        return c.inst_template(turns)

    prefixes = c.Prefixes(counting)
    for i in range(1000):
        prefixes.add("user", str(i))
    assert sum(calls) < 1000 * 2 * 2 * c.WINDOW


def test_templates_that_look_back_any_distance(spark):
    """Pieces add up to the whole conversation's output: by all turns, or by a window if the template states one."""

    def system_with_last(turns):
        """Shows the first turn in the last one, and the answers' numbers: looks back and rewrites."""
        last = len(turns) - 1
        return "".join(f"<{i}>{turns[0][1] if i == last else ''}{text}</{i}>" for i, (_, text) in enumerate(turns))

    def from_afar(turns):
        """Every turn shows how long the one 20 turns before is, and puts a mark on it."""
        marks = [t + ("*" if i + 20 < len(turns) else "") for i, (_, t) in enumerate(turns)]
        return "".join(f"[{len(turns[i - 20][1]) if i >= 20 else 0}:{t}]" for i, t in enumerate(marks))

    stated = functools.partial(from_afar)
    stated.looks_back = 20
    rows = [(4, i, ["user", "assistant"][i % 2], "word " * (i % 7) + str(i), 0, "") for i in range(130)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place long, piece string")
    whole = [(r[2], r[3]) for r in rows]
    assert c.window_of(system_with_last) is None and c.window_of(stated) == 40 and c.window_of(c.inst_template) == c.WINDOW
    for template in (system_with_last, from_afar, stated):
        out = ""
        for t in sorted(c.formatted_turns(df, template).collect(), key=lambda r: r.place):
            out = out[: len(out) - t.replaced] + t.piece
        assert out == template(whole)
