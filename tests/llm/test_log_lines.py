import random
import time

import pytest

from fleetvitals.llm import log_lines, queries
from tests.llm import brute


def corpus(seed=1):
    rng = random.Random(seed)
    base = [[f"t{rng.randrange(40)}" if rng.random() < 0.5 else f"r{rng.randrange(3000)}" for _ in range(rng.randrange(1, 30))] for _ in range(40)]
    texts = {}
    for i in range(50):
        lines = []
        for _ in range(rng.randrange(1, 8)):
            words = list(rng.choice(base))
            if rng.random() < 0.6:
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**5)}"
            lines.append(" ".join(words))
        texts[i * 2 + 1] = "\n".join(lines)
    return texts


@pytest.mark.parametrize("percent", [70, 80, 90, 100])
def test_same_as_brute_force(spark, percent):
    texts = corpus()
    dumps = spark.createDataFrame(list(texts.items()), "dump_id long, content string").repartition(3)
    found = {(r.dump_id, r.line_no) for r in log_lines.duplicate_lines(dumps, percent).collect()}
    expected = brute.later_lines(texts, percent)
    assert found == expected and (expected or percent == 100)
    kept = {r.dump_id: r for r in log_lines.remove_duplicate_lines(dumps, percent).collect()}
    for i, text in texts.items():
        lines = text.split("\n")
        left = [line for k, line in enumerate(lines) if (i, k) not in expected]
        assert (kept[i].n_lines, kept[i].n_removed, kept[i].kept_text) == (len(lines), len(lines) - len(left), "\n".join(left))


def test_odd_rows(odd, nothing):
    found = log_lines.remove_duplicate_lines(odd).collect()
    assert len(found) == odd.count()
    by_id = {r.dump_id: (r.n_lines, r.n_removed, r.kept_text) for r in found}
    assert by_id[2] == (1, 1, "") and by_id[3] == (1, 0, "") and by_id[4] == (0, 0, None) and by_id[5] == (2, 0, " \t\n ")
    assert sum(r.n_removed for r in found) == 2
    assert log_lines.remove_duplicate_lines(nothing).count() == 0


def test_error_log_lines_that_differ_in_a_number(spark):
    text = "\n".join(f"[Warning] aborted connection of user app at host web to database shop after {n} packets" for n in (1, 2, 3))
    dumps = spark.createDataFrame([(1, text)], "dump_id long, content string")
    row = log_lines.remove_duplicate_lines(dumps, 80).first()
    assert row.n_removed == 2 and row.kept_text.endswith("after 1 packets")


def test_query_removes_lines_that_differ_in_a_number(spark, tmp_path):
    """By the query itself, at its own threshold: 15 tokens of which one differs, and 9; 8 are too few."""
    lines = ["[Warning] aborted connection of user app at host web to database shop after {} packets", "a b c d e f g h {}", "i j k l m n o {}"]
    rows = [(i, "s", "en", "\n".join(x.format(i) for x in lines)) for i in (1, 2, 3)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert found == {1: (3, 0, brute.sha(rows[0][3])), 2: (3, 2, brute.sha(lines[2].format(2))), 3: (3, 2, brute.sha(lines[2].format(3)))}


def test_only_frame_functions(spark):
    plan = log_lines.remove_duplicate_lines(spark.createDataFrame([(1, "a b c")], "dump_id long, content string"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {f for i in range(files.size()) if (f := files.apply(i).getName()).startswith("shuffle_")}


def test_shuffles_do_not_add_up_on_disk(spark):
    """What a step has shuffled is gone when the next one needs the room."""
    dumps = spark.createDataFrame(list(corpus().items()), "dump_id long, content string").repartition(3)
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, as_set = shuffle_files(spark), spark.conf.get(setting)
    found = log_lines.duplicate_lines(dumps, 80)
    for _ in range(100):  # they are deleted in the background
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before and spark.conf.get(setting) == as_set
    assert found.count()


@pytest.mark.parametrize("percent", [80, 90])
def test_long_lines_same_as_brute_force(spark, percent):
    """Lines on both sides of the length from which sketches are wider, near and at the threshold."""
    rng = random.Random(7)
    texts, at = {}, 0
    for n in (9, 40, log_lines.LONG_SET - 2, log_lines.LONG_SET, log_lines.LONG_SET + 4, 200, 700):
        for _ in range(2):
            base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            for share in (0, 0.02, 0.05, 0.08, 0.1, 0.11, 0.12, 0.15, 0.3):
                changed = set(rng.sample(range(n), round(share * n)))
                longer = [f"l{rng.randrange(10**6)}" for _ in range(rng.choice((0, 0, n // 12)))]
                texts[at := at + 1] = " ".join([f"x{rng.randrange(10**6)}" if i in changed else w for i, w in enumerate(base)] + longer)
    dumps = spark.createDataFrame(list(texts.items()), "dump_id long, content string")
    found = {(r.dump_id, r.line_no) for r in log_lines.duplicate_lines(dumps, percent).collect()}
    assert found == brute.later_lines(texts, percent) and 10 < len(found) < len(texts)
