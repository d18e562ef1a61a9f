"""Near-duplicate clustering of articles by set similarity within a time window."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import MIN_WORDS_FOR_WORD_SETS, bigram_set, novelty, similarity_text, top_keywords, word_set
from corpusflow.runtime import global_rank, materialize, stored

# Thresholds of the similarity rules.
SIMILARITY = 0.60
NOVELTY = 0.30
IMAGE_BONUS = 0.15
TITLE_LOCK = 0.85
WINDOW_HOURS = 6
WINDOW_ROWS = 200
WINDOW_LEADERS = 200
SETS = ("tw", "tb", "ew", "eb")
WORD_SETS = ("tw", "ew")
#: 64-bit words in the sketch of each set, by the sizes that such sets have.
WORDS = {"tw": 2, "tb": 4, "ew": 4, "eb": 8}
#: Where the words of each set begin among those of all.
FIRST_WORDS = np.cumsum([0, *[WORDS[s] for s in SETS[:-1]]])
#: Rows whose pairs are looked for in one call.
BLOCK_ROWS = 4_000


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly by id, since making token sets costs far more than moving titles and excerpts."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")  # a fixed number, as for the pairs


def features(rows: DataFrame, title: str = "title", excerpt: str = "raw_excerpt") -> DataFrame:
    """Token sets of title and excerpt and the keywords of both, each made once; 64-bit hashes stand for the tokens."""
    norm = rows.withColumn("nt", similarity_text(F.col(title))).withColumn("ne", similarity_text(F.col(excerpt)))
    both = F.trim(F.concat_ws(" ", "nt", "ne"))
    made = {"tw": word_set(F.col("nt")), "tb": bigram_set(F.col("nt")), "ew": word_set(F.col("ne")), "eb": bigram_set(F.col("ne")), "kw": top_keywords(both)}
    return norm.select(*rows.columns, *[F.transform(c, lambda t: F.xxhash64(t)).alias(k) for k, c in made.items()])


def _score(names: tuple[str, str, str, str]) -> Column:
    """Best of word and bigram Jaccard from sizes and common counts; words count from four tokens on."""
    words, grams, n_words, n_grams = (F.col(n) for n in names)
    part = lambda common, x, y: F.when((x > 0) & (y > 0), common / (x + y - common)).otherwise(F.lit(0.0))
    enough = (n_words["a"] >= MIN_WORDS_FOR_WORD_SETS) & (n_words["b"] >= MIN_WORDS_FOR_WORD_SETS)
    return F.greatest(F.when(enough, part(words, n_words["a"], n_words["b"])).otherwise(F.lit(0.0)), part(grams, n_grams["a"], n_grams["b"]))


def with_scores(pairs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` plus ``title_score``, ``excerpt_score`` and ``score`` of pairs of feature rows aliased ``a`` and ``b``.

    Common tokens are counted in a layer of their own, once a pair.
    """
    common = [F.size(F.array_intersect(f"a.{s}", f"b.{s}")).alias(f"common_{s}") for s in ("tw", "tb", "ew", "eb")]
    sizes = [F.struct(F.size(f"a.{s}").alias("a"), F.size(f"b.{s}").alias("b")).alias(f"n_{s}") for s in ("tw", "tb", "ew", "eb")]
    image = F.coalesce((F.col("a.image_url") == F.col("b.image_url")) & (F.col("a.image_url") != ""), F.lit(False)).alias("same_image")
    counts = F.explode(F.array(F.struct(*common, *sizes, image))).alias("__c")  # a filter on the score does not repeat the counting
    counted = pairs.select(*keep, counts)
    names = counted.columns[: len(keep)]
    counted = counted.select(*names, "__c.*")
    scored = counted.select(
        *names, _score(("common_tw", "common_tb", "n_tw", "n_tb")).alias("title_score"), _score(("common_ew", "common_eb", "n_ew", "n_eb")).alias("excerpt_score"), "same_image"
    )
    base = F.greatest("title_score", "excerpt_score", F.col("title_score") * 0.6 + F.col("excerpt_score") * 0.4)
    return scored.withColumn("score", F.least(F.lit(1.0), base + F.when(F.col("same_image"), IMAGE_BONUS).otherwise(0.0)))


def window_pairs(rows: DataFrame, rows_back: int = WINDOW_ROWS, hours: int = WINDOW_HOURS) -> DataFrame:
    """Feature rows ``a`` with each of the ``rows_back`` rows before them within ``hours`` as ``b``.

    Rows are numbered in time order slice by slice; buckets of ``rows_back``
    numbers make the range join an equi-join with at most two buckets a row, so
    the pair space is linear in the input.
    """
    ranked = materialize(global_rank(rows, [F.col("created_at"), F.col("id")], "seq"))
    bucket = F.floor(F.col("seq") / rows_back)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number: pairs cost far more than the bytes that adaptive execution counts
    a = ranked.withColumn("bucket", bucket).repartition(tasks, "bucket").alias("a")
    b = ranked.withColumn("bucket", F.explode(F.array(bucket, bucket + 1))).repartition(tasks, "bucket").alias("b")
    near = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.seq") > F.col("b.seq")) & (F.col("a.seq") - F.col("b.seq") <= rows_back)
    recent = F.unix_timestamp("a.created_at") - F.unix_timestamp("b.created_at") <= hours * 3600
    return a.join(b, near & recent)


def odd_bits(tokens: Column, words: int) -> Column:
    """A sketch of a set of hashes in 64-bit words: a bit is set where an odd number of tokens falls on it."""
    word = lambda t: F.pmod(F.shiftright(t, 6), F.lit(words))
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int"))
    fold = lambda w: F.aggregate(F.filter(tokens, lambda t: word(t) == w), F.lit(0).cast("long"), lambda x, t: x.bitwiseXOR(bit(t)))
    return F.transform(F.sequence(F.lit(0), F.lit(words - 1)), fold)


def sketches(base: DataFrame, keep: list[str]) -> DataFrame:
    """Sizes and sketches of the token sets of feature rows, beside the columns ``keep``."""
    return stored(base.select(*keep, *[c for s in SETS for c in (F.size(s).alias(f"n_{s}"), odd_bits(F.col(s), WORDS[s]).alias(f"bits_{s}"))]))


def _may_be_similar(rows: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the sketched rows ``a`` and ``b`` can reach the threshold: false only if no pair of their sets can.

    Sets of Jaccard similarity s differ in at most (1 - s) / (1 + s) of their summed
    sizes, and two sketches in no more bits than their sets in tokens.
    """
    reach = lambda t: (1 - t) / (1 + t) + 1e-9
    share = np.where((rows["image"][a] == rows["image"][b]) & rows["pictured"][a] & rows["pictured"][b], reach(SIMILARITY - IMAGE_BONUS), reach(SIMILARITY))
    out = np.zeros(len(a), bool)
    for s in SETS:
        x, y = rows[f"n_{s}"][a], rows[f"n_{s}"][b]
        least = MIN_WORDS_FOR_WORD_SETS if s in WORD_SETS else 1
        odd = np.bitwise_count(rows[f"bits_{s}"][a] ^ rows[f"bits_{s}"][b]).sum(axis=1, dtype=np.int64)
        out |= (x >= least) & (y >= least) & (np.abs(x - y) <= share * (x + y)) & (odd <= share * (x + y))
    return out


def candidate_pairs(base: DataFrame, among: Column | None = None) -> DataFrame:
    """``(id, other_id, seq)``: of the pairs in the window those whose sketches leave room for the threshold; ``seq`` numbers the other row.

    Only rows of which ``among`` is true look back.  Rows are numbered in time order
    and cut into blocks, each with the ``WINDOW_ROWS`` rows before it; a task holds the
    sizes and sketches of one block, and the token sets stay where they are.
    """
    own = base.withColumn("open", F.lit(True) if among is None else F.coalesce(among, F.lit(False)))
    image = [F.coalesce(F.xxhash64("image_url"), F.lit(0)).alias("image"), F.col("image_url").isNotNull().alias("pictured")]
    made = sketches(own, ["id", "created_at", "image_url", "open"])
    ranked = materialize(global_rank(made, [F.col("created_at"), F.col("id")], "seq"))
    timed = ranked.where("created_at is not null")  # rows without a time are in no window
    sizes = [f"n_{s}" for s in SETS]
    block = F.floor(F.col("seq") / BLOCK_ROWS)
    reached = F.array_distinct(F.array(block, F.floor((F.col("seq") + WINDOW_ROWS) / BLOCK_ROWS)))
    rows = timed.select("id", "seq", "open", F.unix_timestamp("created_at").alias("at"), *image, *sizes, *[F.get(f"bits_{s}", F.lit(i)).alias(f"bits_{s}_{i}") for s in SETS for i in range(WORDS[s])], F.explode(reached).alias("block"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        rows = {c: table[c].to_numpy() for c in ("seq", "open", "at", "image", "pictured", "block", *sizes)}
        rows |= {f"bits_{s}": np.stack([table[f"bits_{s}_{i}"].to_numpy() for i in range(WORDS[s])], axis=1).view(np.uint64) for s in SETS}  # bits of signed numbers are not counted one by one
        looks = rows["open"] & (rows["seq"] // BLOCK_ROWS == rows["block"])
        later, earlier = [], []
        for back in range(1, min(WINDOW_ROWS, len(looks) - 1) + 1):  # rows follow each other without a gap
            a = np.flatnonzero(looks[back:] & (rows["at"][back:] - rows["at"][:-back] <= WINDOW_HOURS * 3600)) + back
            a = a[_may_be_similar(rows, a, a - back)]
            later.append(a)
            earlier.append(a - back)
        a, b = (pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)) for x in (later, earlier))
        return pa.table({"id": table["id"].take(a), "other_id": table["id"].take(b), "seq": table["seq"].take(b)})

    kind = base.schema["id"].dataType.simpleString()
    tasks = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number: pairs cost far more than the bytes that adaptive execution counts
    return materialize(rows.repartition(tasks, "block").groupBy("block").applyInArrow(run, f"id {kind}, other_id {kind}, seq long"))


def _scored(base: DataFrame, pairs: DataFrame, keep: list[Column]) -> DataFrame:
    """Scores of candidate pairs, for which the token sets of both rows are fetched by id."""
    tasks = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b, p = base.alias("a"), base.repartition(tasks, "id").alias("b"), pairs.alias("p")
    both = p.join(a, F.col("p.id") == F.col("a.id")).repartition(tasks, F.col("p.other_id"))  # a fixed number, as for the pairs
    return with_scores(both.join(b, F.col("p.other_id") == F.col("b.id")), keep)


def similar_pairs(base: DataFrame) -> DataFrame:
    """``(id, other_id, score)`` of all pairs of feature rows in the window whose score reaches the threshold."""
    base = stored(base)
    scored = _scored(base, candidate_pairs(base), [F.col("p.id").alias("id"), F.col("p.other_id").alias("other_id")])
    return scored.where(F.col("score") >= SIMILARITY).select("id", "other_id", "score")


def parent_edges(articles: DataFrame, is_forum: Column | None = None, title: str = "title", excerpt: str = "raw_excerpt") -> DataFrame:
    """``(id, best_id, title_score, score, novelty, accepted)``: the best earlier row of each similar row.

    The highest score of at least the threshold wins, the newest of equals; it is
    accepted if the titles nearly agree or little is new, else none is tried again.
    """
    forum = F.lit(False) if is_forum is None else F.coalesce(is_forum, F.lit(False))
    rows = articles.select("id", "created_at", "image_url", title, excerpt, forum.alias("is_forum"))
    base = stored(features(spread(rows), title, excerpt).drop(title, excerpt))
    keep = [F.col("p.id").alias("id"), F.col("p.other_id").alias("best_id"), F.col("p.seq").alias("seq"), F.col("a.kw").alias("own"), F.col("b.kw").alias("theirs")]
    scored = _scored(base, candidate_pairs(base, ~F.col("is_forum")), keep)
    best = F.max(F.when(F.col("score") >= SIMILARITY, F.struct("score", "seq", "best_id", "title_score", novelty(F.col("own"), F.col("theirs")).alias("novelty"))))
    top = scored.groupBy("id").agg(best.alias("m")).where("m is not null").select("id", "m.best_id", "m.title_score", "m.score", "m.novelty")
    return top.withColumn("accepted", (F.col("title_score") >= TITLE_LOCK) | (F.col("novelty") < NOVELTY))


def roots(edges: DataFrame) -> DataFrame:
    """``(id, parent_article_id)`` from ``(id, parent)`` edges to earlier rows: pointers doubled until each reaches a leader."""
    now = materialize(edges.select("id", "parent"))
    while True:
        up = now.select(F.col("id").alias("parent"), F.col("parent").alias("next"))
        nxt = materialize(now.join(up, "parent", "left").select("id", F.coalesce("next", "parent").alias("parent"), F.col("next").isNotNull().alias("moved")))
        now = nxt.select("id", "parent")
        if nxt.where("moved").isEmpty():
            return now.select("id", F.col("parent").alias("parent_article_id"))


def cluster(articles: DataFrame, is_forum: Column | None = None) -> DataFrame:
    """Articles with ``parent_article_id`` (their cluster's leader) and ``skipped`` status for followers."""
    edges = parent_edges(articles, is_forum).where("accepted").select("id", F.col("best_id").alias("parent"))
    found = roots(edges).withColumnRenamed("parent_article_id", "__parent")
    out = articles.join(found, "id", "left")
    return out.withColumn("parent_article_id", F.col("__parent")).withColumn("summary_status", F.when(F.col("__parent").isNotNull(), "skipped").otherwise(F.col("summary_status"))).select(*articles.columns)


class _Article:
    """Token sets of one row with their sketches, for the sweep of the second pass."""

    def __init__(self, row):
        self.place = (row.created, row.id)
        self.image, self.forum = row.image_url, row.forum
        self.sets = [frozenset(getattr(row, s).tolist()) for s in SETS]
        packed = [np.packbits(np.bincount(getattr(row, s) & (64 * WORDS[s] - 1), minlength=64 * WORDS[s]) & 1) for s in SETS]
        self.sketch = [int.from_bytes(p.tobytes()) for p in packed]
        self.words = np.concatenate(packed).view(np.uint64)
        self.keywords = frozenset(row.kw.tolist())

    def __lt__(self, other: _Article) -> bool:
        return self.place < other.place

    def scores(self, other: _Article) -> tuple[float, float] | None:
        """Score and title score of two rows as ``with_scores`` gives them, or None where the sketches leave no room for the threshold."""
        same = bool(self.image) and self.image == other.image
        least = SIMILARITY - (IMAGE_BONUS if same else 0)
        share = (1 - least) / (1 + least) + 1e-9
        if not any((x ^ y).bit_count() <= share * (len(a) + len(b)) for x, y, a, b in zip(self.sketch, other.sketch, self.sets, other.sets, strict=True)):
            return None
        part = []
        for name, a, b in zip(SETS, self.sets, other.sets, strict=True):
            common = len(a & b) if len(a) >= (floor := MIN_WORDS_FOR_WORD_SETS if name in WORD_SETS else 1) and len(b) >= floor else 0
            part.append(common / (len(a) + len(b) - common) if common else 0.0)
        title, excerpt = max(part[:2]), max(part[2:])
        return min(1.0, max(title, excerpt, title * 0.6 + excerpt * 0.4) + (IMAGE_BONUS if same else 0.0)), title


class _Leaders:
    """The ``most`` newest leaders in order of time, with their sketches in arrays beside them."""

    def __init__(self, start: Iterator, most: int):
        self.most, self.all = most, []
        self.words = np.zeros((most + 1, sum(WORDS.values())), np.uint64)
        self.sizes = np.zeros((most + 1, len(SETS)), np.int64)
        self.images = np.zeros(most + 1, np.int64)
        for row in start:
            self.add(_Article(row))

    def add(self, own: _Article) -> None:
        n, at = len(self.all), bisect_right(self.all, own)
        self.all.insert(at, own)
        for name, value in (("words", own.words), ("sizes", [len(s) for s in own.sets]), ("images", hash(own.image))):
            held = getattr(self, name)
            held[at + 1 : n + 1] = held[at:n].copy()
            held[at] = value
            if n == self.most:
                held[:n] = held[1:].copy()
        del self.all[: -self.most]

    def like(self, own: _Article, since: int) -> list[_Article]:
        """The leaders since a time whose sketches leave room for the threshold, the newest first; the test is that of ``_Article.scores``."""
        low, n = bisect_left(self.all, since, key=lambda a: a.place[0]), len(self.all)
        if low == n:
            return []
        share = [(1 - t) / (1 + t) + 1e-9 for t in (SIMILARITY, SIMILARITY - IMAGE_BONUS)]
        share = np.where(self.images[low:n] == hash(own.image), share[1], share[0]) if own.image else np.full(n - low, share[0])
        odd = np.add.reduceat(np.bitwise_count(self.words[low:n] ^ own.words), FIRST_WORDS, axis=1, dtype=np.int64)
        room = (odd <= share[:, None] * (self.sizes[low:n] + [len(s) for s in own.sets])).any(axis=1)
        return [self.all[low + i] for i in np.flatnonzero(room)[::-1].tolist()]


def _swept(rows: Iterator, start: Iterator, most: int, hours: int) -> tuple[dict, list[_Article]]:
    """Parents of ``rows``, taken in order from the leaders ``start``, and the ``most`` newest leaders after them."""
    leads = _Leaders(start, most)
    parents = {}
    for row in rows:
        own, best = _Article(row), None
        if not own.forum:
            for other in leads.like(own, row.at - hours * 3_600_000_000):  # the newest first: of equal scores it wins
                if not other.forum and (found := own.scores(other)) and found[0] >= SIMILARITY and (best is None or found[0] > best[0][0]):
                    best = found, other
        if best:
            new = len(own.keywords - best[1].keywords) / len(own.keywords) if own.keywords else 0.0
            if best[0][1] >= TITLE_LOCK or new < NOVELTY:
                parents[row.id] = best[1].place[1]
                continue
        if not pd.isna(row.created):
            leads.add(own)
    return parents, leads.all


def settled_parents(rows: DataFrame, most: int = WINDOW_LEADERS, hours: int = WINDOW_HOURS, slice_rows: int = 20_000, warm_rows: int = 2_000) -> DataFrame:
    """``(id, parent)`` by the sequential rule over feature rows with ``at``, ``created`` (microseconds) and ``forum``.

    Each row meets, at its turn by ``(at, id)``, the ``most`` newest rows that are
    still leaders, and attaches to the best; forum rows count among the newest but
    neither attach nor lead.  What a row may meet depends on all decisions before
    it, but only through the ``most`` newest leaders: no leader ceases to be one, so
    the others never come back.  Slices of ``slice_rows`` rows are hence swept side by
    side, each from the leaders that the last ``warm_rows`` rows of the slice before
    leave alone; slices whose predecessor ends with other leaders are swept again
    until all agree.  The first slice is right from the start and each round makes
    another one right, so the rows are those of one sweep.
    """
    order = global_rank(rows.select("id", "at"), [F.col("at"), F.col("id")], "seq")
    order = order.select("id", "seq", F.floor((F.col("seq") - 1) / slice_rows).alias("slice"))
    table = stored(rows.join(order, "id"))
    n_slices = (table.agg(F.max("slice")).first()[0] or 0) + 1
    kind = rows.schema["id"].dataType.simpleString()

    def run(own: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({"slice": [], "leads": [], "id": [], "parent": []})
        own = own.sort_values("seq")
        parents, leads = _swept(own.itertuples(), start.itertuples(), most, hours)
        ids = [a.place[1] for a in leads]
        return pd.DataFrame({"slice": own["slice"].iloc[0], "leads": [False] * len(parents) + [True] * len(ids), "id": [*parents, *ids], "parent": [*parents.values(), *[None] * len(ids)]}).astype({"parent": object})

    def sweep(own: DataFrame, leads: DataFrame) -> DataFrame:
        start = table.drop("slice").join(leads.select("slice", "id"), "id")  # at most ``most`` rows a slice
        start = start.toDF(*start.columns)  # columns of their own beside those of ``own``
        return materialize(own.groupBy("slice").cogroup(start.groupBy("slice")).applyInPandas(run, f"slice long, leads boolean, id {kind}, parent {kind}"))

    def left_by(swept: DataFrame) -> DataFrame:
        return swept.where("leads").select((F.col("slice") + 1).alias("slice"), "id").where(F.col("slice") < n_slices)

    def of(leads: DataFrame, name: str) -> DataFrame:
        return leads.groupBy("slice").agg(F.sort_array(F.collect_list("id")).alias(name))

    none = table.select("slice", "id").limit(0)
    tail = table.where((F.col("slice") < n_slices - 1) & (F.col("seq") > (F.col("slice") + 1) * slice_rows - warm_rows))
    used = left_by(sweep(tail, none)) if n_slices > 1 else none
    done = sweep(table, used)
    while n_slices > 1:
        now = left_by(done)
        both = of(now, "now").join(of(used, "used"), "slice", "full_outer")
        wrong = materialize(both.where(~F.col("now").eqNullSafe(F.col("used"))).select("slice"))
        if wrong.isEmpty():
            break
        used = materialize(used.join(wrong, "slice", "left_anti").unionByName(now.join(wrong, "slice", "left_semi")))
        again = sweep(table.join(wrong, "slice", "left_semi"), used.join(wrong, "slice", "left_semi"))
        done = materialize(done.join(wrong, "slice", "left_anti").unionByName(again))
    return done.where("not leads").select("id", "parent")


def second_pass(articles: DataFrame, is_forum: Column, as_of: Column, finished: str = "created_at", leaders: int = WINDOW_LEADERS, slice_rows: int = 20_000) -> DataFrame:
    """After the summaries: leaders are compared on translated title and short summary, in the order of ``finished``.

    Rows take part that are done by ``as_of``, lead and have a translated title.  At
    its turn a row meets, of the rows that were finished before and still lead, the
    ``leaders`` newest, as far as they were created in the six hours before; the best
    score wins, the newest of equals, and if that one is not accepted, no other is
    tried (``settled_parents``).  Forum rows attach to nothing and nothing to them,
    but they count among the newest.  Followers of a row that attaches move along;
    the status stays and ``last_summary_error`` notes the leader.
    """
    done = (F.col("summary_status") == "done") & F.col("parent_article_id").isNull() & F.col("translated_title").isNotNull()
    columns = ["id", "created_at", "image_url", "translated_title", "summary_short", *([finished] if finished != "created_at" else [])]
    rows = articles.where(done & (F.col(finished) <= as_of)).select(*columns, F.coalesce(is_forum, F.lit(False)).alias("forum"))
    base = features(spread(rows), "translated_title", "summary_short")
    base = base.select("id", F.unix_micros(F.col(finished).cast("timestamp")).alias("at"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("created"), "image_url", "forum", *SETS, "kw")
    moved = settled_parents(base, leaders, WINDOW_HOURS, slice_rows).select("id", F.col("parent").alias("__new"))
    out = articles.join(moved, "id", "left").withColumn("parent_article_id", F.coalesce("__new", "parent_article_id"))
    note = F.concat(F.lit("Clustered after summary into "), F.col("__new").cast("string"))
    out = out.withColumn("last_summary_error", F.when(F.col("__new").isNotNull(), note).otherwise(F.col("last_summary_error"))).drop("__new")
    return flatten(out.select(*articles.columns))


def flatten(articles: DataFrame) -> DataFrame:
    """Followers of a follower are given its leader."""
    links = articles.where("parent_article_id is not null").select("id", F.col("parent_article_id").alias("parent"))
    top = roots(links).withColumnRenamed("parent_article_id", "__top")
    return articles.join(top, "id", "left").withColumn("parent_article_id", F.col("__top")).select(*articles.columns)


def attach(articles: DataFrame, edits: DataFrame, as_of: Column) -> DataFrame:
    """Manual ``edits(id, leader_id)``: the target must be another article and a leader; a null leader detaches, skipped goes back to pending."""
    leaders = articles.where("parent_article_id is null").select(F.col("id").alias("leader_id"), F.lit(True).alias("__ok"))
    e = edits.join(leaders, "leader_id", "left").where("leader_id is null or (__ok and leader_id <> id)").select("id", "leader_id", F.lit(True).alias("__hit"))
    out = articles.join(e, "id", "left")
    detach = F.col("__hit").isNotNull() & F.col("leader_id").isNull()
    out = out.withColumn("summary_status", F.when(detach & (F.col("summary_status") == "skipped"), "pending").otherwise(F.col("summary_status")))
    out = out.withColumn("parent_article_id", F.when(F.col("__hit").isNotNull(), F.col("leader_id")).otherwise(F.col("parent_article_id")))
    return flatten(out.select(*articles.columns))
