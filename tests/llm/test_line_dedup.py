import random

from ontocat.llm import line_dedup as L

from .helpers import empty_docs, messy_docs

DOCS = "doc_id bigint, text string"


def run(spark, rows):
    done = L.dedup_lines(spark.createDataFrame(rows, DOCS)).select("doc_id", "deduped.*").collect()
    return {r.doc_id: (r.n_lines, r.n_deleted, r.text) for r in done}


def test_patience_is_the_longest_chain():
    rng = random.Random(1)
    for _ in range(100):
        p = list(range(8))
        rng.shuffle(p)
        chain = L.patience(list(enumerate(p)))
        best = max((bin(m).count("1") for m in range(256) for s in [[p[i] for i in range(8) if m >> i & 1]] if s == sorted(s)), default=0)
        assert len(chain) == best and chain == sorted(chain) and [b for _, b in chain] == sorted(b for _, b in chain)


LINES = [f"line number {i} has these several words" for i in range(30)]


def test_blocks_go_from_the_later_document(spark):
    first = "\n".join(LINES[:10])
    out = run(spark, [(1, first), (2, "\n".join(["own words of the second document", *LINES[3:6], "", "ok", "its own end"])),
                      (3, "\n".join([*LINES[3:6], "", "ok", "something else here that is new"])), (4, first), (5, None), (6, "")])
    assert out[1] == (10, 0, first) and out[4] == (10, 10, "")
    assert out[2] == (7, 3, "own words of the second document\n\nok\nits own end")
    assert out[3] == (6, 3, "\nok\nsomething else here that is new")
    assert out[5] == (0, 0, None) and out[6] == (1, 0, "")


def test_order_decides_which_lines_are_aligned(spark):
    a, b = "\n".join(LINES[:6]), "\n".join([*LINES[3:6], *LINES[:3]])
    n, gone, left = run(spark, [(1, a), (2, b)])[2]
    assert (n, gone) == (6, 3) and left in ("\n".join(LINES[:3]), "\n".join(LINES[3:6]))


def test_short_and_repeated_lines_only_inside_blocks(spark):
    a = "\n".join([LINES[0], "}", LINES[1], "}", "tail of the first"])
    b = "\n".join(["}", "head of the second one is here", LINES[0], "}", LINES[1], "}"])
    assert run(spark, [(1, a), (2, b)])[2] == (6, 4, "}\nhead of the second one is here")


def test_many_copies(spark):
    text = "\n".join(LINES)
    out = run(spark, [(i, text + f"\nthe last line of number {i} alone") for i in range(300)])
    assert out[0][1] == 0 and all(out[i] == (31, 30, f"the last line of number {i} alone") for i in range(1, 300))


def test_messy_and_empty(spark):
    docs = messy_docs(spark)
    done = L.dedup_lines(docs, out="x")
    assert done.count() == docs.count() and done.columns == [*docs.columns, "x"]
    rows = {r.doc_id: r.x for r in done.collect() if r.doc_id is not None}
    assert rows[1].n_deleted == 0 and rows[2].n_deleted == 1 and rows[5].n_lines == 0 and rows[3].n_deleted == 0
    assert L.dedup_lines(empty_docs(spark)).count() == 0


def chains(later, earlier):
    """All lines of both documents aligned, without the operator's code: positions of the later one in common blocks."""
    once = [x for x in later if len(x.replace(" ", "")) >= L.ANCHOR_CHARS and later.count(x) == 1 == earlier.count(x)]
    chain = [(later.index(x), earlier.index(x)) for x in once]
    best = L.patience(chain)  # once is in order of the later document
    found = set()
    for n, (i, j) in enumerate(best):
        for step, stop in ((-1, best[n - 1] if n else (-1, -1)), (1, best[n + 1] if n + 1 < len(best) else (len(later), len(earlier)))):
            a, b = i, j
            while a != stop[0] and b != stop[1] and later[a] and later[a] == earlier[b]:
                found.add(a)
                a, b = a + step, b + step
    return found


def test_against_alignment_of_all_pairs(spark):
    rng = random.Random(11)
    for _ in range(3):
        pool = [f"line {i} of the pool" for i in range(12)] + ["}", "ok", "一二三四五六"]
        texts = [[f"head of {i} alone", *rng.choices(pool, k=rng.randrange(2, 9))] for i in range(25)]
        out = run(spark, [(i, "\n".join(t)) for i, t in enumerate(texts)])
        left = [out[i][2].split("\n") for i in range(len(texts))]
        for i, mine in enumerate(texts):
            reached = {e: chains(mine, texts[e]) for e in range(i)}
            every = set().union(*reached.values())
            for at, x in enumerate(mine):
                if mine.count(x) == 1:
                    if x not in left[i]:
                        assert at in every  # what goes is in a block shared with an earlier document
                    elif len(x.replace(" ", "")) >= L.ANCHOR_CHARS:  # what stays is out of reach of all that keep it
                        assert all(at not in reached[e] for e in range(i) if x in left[e] and texts[e].count(x) == 1)


def test_owner_with_a_repeated_line_is_no_obstacle(spark):
    x = LINES[0]
    out = run(spark, [(1, f"{x}\nmiddle of the first one alone\n{x}"), (2, f"{x}\nsecond"), (3, f"third\n{x}"), (4, f"{x}\nfourth")])
    assert [out[i][1] for i in (1, 2, 3, 4)] == [0, 0, 1, 1]


def test_neighbours_of_a_third_owner_belong_to_the_block(spark):
    out = run(spark, [(1, "}\nfirst document and its own line"), (2, f"{LINES[0]}\n}}\n{LINES[1]}"), (3, f"{LINES[0]}\n}}\nend of three")])
    assert out[1][1] == 0 and out[2][1] == 0 and out[3] == (3, 2, "end of three")


def test_moved_lines_find_another_partner(spark):
    a, b = "\n".join(LINES[:6]), "\n".join([*LINES[3:6], *LINES[:3], "second"])
    out = run(spark, [(1, a), (2, b), (3, "\n".join([*LINES[3:6], *LINES[:3], "third"]))])
    assert out[2][1] == 3 and out[3] == (7, 6, "third")


def test_copies_of_short_lines_and_texts_without_blanks(spark):
    short, chinese = "- a\n- b\n\n- a", "我们在这里读书"
    out = run(spark, [(1, short), (2, short), (3, "- a"), (4, chinese + "\nfour"), (5, "five\n" + chinese), (6, short + "\n- c")])
    assert out[2] == (4, 3, "") and out[3][1] == 0 and out[4][1] == 0 and out[5] == (2, 1, "five") and out[6][1] == 0
