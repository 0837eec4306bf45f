"""Spelling variants: words of the corpus's own vocabulary that are one edit apart, by composition of finite-state machines.

The vocabulary is a minimised acyclic acceptor A, and T a transducer that makes exactly one edit; A o T o A accepts the
pairs of near words.  The composition starts from many initial states apart from each other: the state of A after the
first half of a word, for edits behind it, and the state of the acceptor of reversed words after its second half, for edits
before it.  Words of one such state meet in one task; a state with too many words is left for states that fix everything
but one position, where no more words can meet than there are letters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.shared import shared_table

LETTERS = "a-zÀ-ÿ"
MIN_CHARS = 6
MIN_COUNT = 5
RATIO = 5
SLIP = 199
HELD_WORDS = 200_000
STATE_WORDS = 20_000
BATCH_ROWS = 1 << 16

State = tuple[bool, dict[str, int]]


class Acceptor:
    """Minimised states of several sorted word lists in one register: states with equal numbers accept the same endings."""

    def __init__(self) -> None:
        self.states: list[State] = []
        self.register: dict[tuple, int] = {}
        self.endings: dict[int, list[str]] = {}
        self.shared: dict[tuple[int, int], list[str]] = {}

    def _number(self, final: bool, steps: dict[str, int]) -> int:
        key = (final, *steps.items())
        found = self.register.get(key)
        if found is None:
            found = self.register[key] = len(self.states)
            self.states.append((final, steps))
        return found

    def add(self, words: list[str]) -> int | None:
        """The initial state that accepts the words, which are sorted and distinct; none without words."""
        if not words:
            return None
        open_states: list[list] = [[False, {}]]
        last = ""
        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            for at in range(len(last), same, -1):
                open_states[at - 1][1][last[at - 1]] = self._number(*open_states.pop())
            open_states += [[False, {}] for _ in range(len(word) - same)]
            open_states[-1][0] = True
            last = word
        for at in range(len(last), 0, -1):
            open_states[at - 1][1][last[at - 1]] = self._number(*open_states.pop())
        return self._number(*open_states[0])

    def common(self, first: int, second: int) -> list[str]:
        """The endings that both states accept."""
        if first > second:
            first, second = second, first
        known = self.endings if first == second else self.shared
        key = first if first == second else (first, second)
        found = known.get(key)
        if found is None:
            (final, steps), (other_final, others) = self.states[first], self.states[second]
            found = [""] if final and other_final else []
            if len(others) < len(steps):
                steps, others = others, steps
            for char, below in steps.items():
                if char in others:
                    found += [char + rest for rest in self.common(below, others[char])]
            known[key] = found
        return found

    def near(self, short: int, long: int | None) -> Iterator[tuple[str, str]]:
        """Pairs that one edit makes of each other: both from ``short`` (a replaced symbol), or the second from ``long``
        (an inserted one, counted where it stands last among equal neighbours).  Each pair once.
        """
        todo: list[tuple[str, int, int | None]] = [("", short, long)]
        while todo:
            read, at, other = todo.pop()
            steps = self.states[at][1]
            inserts = {} if other is None else self.states[other][1]
            chars = list(steps)
            for k, char in enumerate(chars):
                for second in chars[k + 1 :]:
                    for rest in self.common(steps[char], steps[second]):
                        yield read + char + rest, read + second + rest
                todo.append((read + char, steps[char], inserts.get(char)))
            for char, below in inserts.items():
                for rest in self.common(below, at):
                    if not rest.startswith(char):
                        yield read + rest, read + char + rest


def near_words(words: list[str], size: int, at: int, back: bool, exact: bool) -> Iterator[tuple[str, str]]:
    """Pairs of one initial state: words of ``size`` symbols with each other, or with one of a symbol more.

    All words agree in the ``at`` symbols that are read before the state; ``back`` reads from the end.  The first symbol in
    which a pair differs has to stand behind the first half, before it (``back``), or at ``at`` itself (``exact``).
    """
    turn = -1 if back else 1
    ends = [w[::turn][at:] for w in words]
    read = words[0][::turn][:at]
    acceptor = Acceptor()
    short = acceptor.add(sorted(e for e in ends if len(e) == size - at))
    if short is None:
        return
    long = acceptor.add(sorted(e for e in ends if len(e) > size - at))
    half = size // 2
    for one, two in acceptor.near(short, long):
        u, v = (read + one)[::turn], (read + two)[::turn]
        if (u[:half] != v[:half]) if back else not exact or u[: at + 1] != v[: at + 1]:
            yield u, v


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: runs of letters of whole texts, A-Z in lower case, with the slips of the pen that the contract makes.

    A run's checksum over ``<id>:<run>`` decides whether and which symbol is lost; a null id is written as nothing.  A
    document's equal runs are looked at once; counts are added up in the task, then by Spark before and after the shuffle.
    """
    runs_of = re.compile(f"[{LETTERS}]{{{min_chars},}}")  # a shorter run cannot become a longer word
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")

    def emit(counts: Counter) -> Iterator[pa.RecordBatch]:
        words = list(counts)
        for k in range(0, len(words), BATCH_ROWS):
            part = words[k : k + BATCH_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([counts[w] for w in part], pa.int64())], names=["word", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                own = Counter(runs_of.findall(text.as_buffer().to_pybytes().lower().decode()))  # bytes: only A-Z have a lower case
                start = zlib.crc32(f"{key.as_py() or ''}:".encode())
                for run, n in own.items():
                    h = zlib.crc32(run.encode(), start)
                    if h % SLIP == 0:
                        run = run[: h % len(run)] + run[h % len(run) + 1 :]
                        if len(run) < min_chars:
                            continue
                    counts[run] += n
                if len(counts) > HELD_WORDS:
                    yield from emit(counts)
                    counts = Counter()
        yield from emit(counts)

    made = rows.mapInArrow(work, "word string, n bigint")
    return made.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _coarse(words: DataFrame, min_chars: int) -> DataFrame:
    """Each word under the initial states of its own size class, and of the one below, where it has a symbol more."""
    half = (F.col("size") / 2).cast("int")
    sized = words.withColumn("size", F.explode(F.filter(F.array(F.length("word") - 1, F.length("word")), lambda n: n >= min_chars)))
    front = F.struct(F.lit(False).alias("back"), half.alias("at"), F.left("word", half).alias("read"))
    end = F.struct(F.lit(True).alias("back"), (F.col("size") - half).alias("at"), F.right("word", F.col("size") - half).alias("read"))
    rows = sized.withColumn("s", F.explode(F.array(front, end))).select("word", "n", "size", "s.*")
    return rows.withColumn("state", F.concat_ws(":", "back", "size", "read")).drop("read")


def _fine(rows: DataFrame) -> DataFrame:
    """Rows of full states under states that fix all but one position: the symbol there replaced, or one inserted."""
    half = (F.col("size") / 2).cast("int")
    places = F.when(F.col("back"), F.sequence(F.lit(0), half - 1)).otherwise(F.sequence(half, F.col("size")))
    placed = rows.select("word", "n", "size", F.explode(places).alias("at"))

    def state(kind: str, rest: Column) -> Column:
        return F.concat_ws(":", F.lit(kind), "size", "at", rest)

    without = F.concat(F.left("word", F.col("at")), F.substr("word", F.col("at") + 2))
    own = F.length("word") == F.col("size")
    states = F.filter(F.array(F.when(own & (F.col("at") < F.col("size")), state("replaced", without)), state("inserted", F.when(own, F.col("word")).otherwise(without))),
                      lambda s: s.isNotNull())
    return placed.select("word", "n", "size", F.lit(False).alias("back"), "at", F.explode(states).alias("state"))


def near_pairs(words: DataFrame, min_chars: int = MIN_CHARS, state_words: int = STATE_WORDS) -> DataFrame:
    """word, n, near, near_n: all pairs of words that one inserted, deleted or replaced code point makes equal, both ways.

    ``words``: word, n; distinct words of at least ``min_chars`` code points.  ``state_words`` bounds how many words one
    initial state brings together; it changes the plan, not the result.  No words give no pairs.
    """
    coarse = _coarse(words, min_chars)
    full = coarse.groupBy("state").count().where(F.col("count") > state_words).select("state")
    fine = _fine(coarse.join(full, "state", "left_semi")).withColumn("exact", F.lit(True))
    rows = coarse.join(full, "state", "left_anti").withColumn("exact", F.lit(False)).unionByName(fine)
    dealt = rows.select("state", "size", "at", "back", "exact", "word", "n").repartition("state").sortWithinPartitions("state")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[str, int, str, int]] = []
        held: dict[str, int] = {}
        now = None

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*pairs, strict=True)) or [(), (), (), ()]
            pairs.clear()
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["word", "n", "near", "near_n"])

        def compose() -> Iterator[pa.RecordBatch]:
            for u, v in near_words(list(held), *now[1:]) if len(held) > 1 else ():
                pairs.append((u, held[u], v, held[v]))
                pairs.append((v, held[v], u, held[u]))
                if len(pairs) >= BATCH_ROWS:
                    yield batch_of()

        for batch in batches:
            for state, size, at, back, exact, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or state != now[0]:
                    yield from compose()
                    held, now = {}, (state, size, at, back, exact)
                held[word] = n
        yield from compose()
        yield batch_of()

    return dealt.mapInArrow(work, "word string, n bigint, near string, near_n bigint")


def chain_ends(links: DataFrame) -> DataFrame:
    """(word, form) links without circles to (word, root): where the chain of forms ends, by doubling the steps.

    The number of rounds is the logarithm of the longest chain; each round is written to the shared folder.
    """
    jumps = shared_table(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "forms")
    while not jumps.where("moved").isEmpty():
        onward = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = jumps.join(onward, "root", "left")
        jumps = shared_table(stepped.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
    return jumps.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT,
             ratio: int = RATIO, state_words: int = STATE_WORDS) -> DataFrame:
    """word, n, n_near, form, form_n, root: each word of the vocabulary with its near words and the spelling it varies.

    ``form`` is the most frequent near word (ties: the first in code-point order) if it is ``ratio`` times as frequent, else
    null; ``root`` is the end of the chain of forms, the word itself without one.  Null texts have no words, repeated rows
    count as often as they come, other columns are not looked at, and an empty table gives no rows.
    """
    words = shared_table(word_counts(docs, id_col, text_col, min_chars, min_count), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near"))).alias("best")
    near = near_pairs(words, min_chars, state_words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    strong = -F.col("best.rank") >= ratio * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.rank")).alias("form_n"))
    found = shared_table(found, "variants")
    ends = chain_ends(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("word", "form", "root", "n", "n_near", "form_n")


ORACLE = f"""
WITH RECURSIVE runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Z{LETTERS}]{{{MIN_CHARS},}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
own AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS hexed FROM runs GROUP BY doc_id, run),
summed AS (SELECT run, n, xor(list_reduce([4294967295] || list_transform(range(length(hexed) // 2), lambda k: CAST('0x' || substring(hexed, 2 * k + 1, 2) AS BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295) AS h FROM own),
made AS (SELECT CASE WHEN h % {SLIP} = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM summed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= {MIN_CHARS} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
cut AS MATERIALIZED (SELECT word, n, k, substring(word, 1, k) || substring(word, k + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS k FROM words)),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
ranked AS (SELECT word, count(*) OVER (PARTITION BY word) AS n_near, near, near_n, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM pairs),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= {RATIO} * w.n THEN r.near END AS form, CASE WHEN r.near_n >= {RATIO} * w.n THEN r.near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
chain(word, root) AS (SELECT word, word FROM forms UNION SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)"""
