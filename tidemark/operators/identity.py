"""Identity: closures of merge pointers, match graphs, and decisions on pairs of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.sources.tables import Rounds, Scratch, delete, store_at, stored


def closure(edges: DataFrame, child: str = "id", parent: str = "superseded_by", max_rounds: int = 60) -> DataFrame:
    """(id, live): each id with the end of its chain of pointers, itself if it has none.

    Pointers are doubled each round, so a chain of n takes log n joins.  Ids on a cycle
    have no end; they get the smallest id that they reach, so the result is defined.
    """
    rounds = Rounds()
    ended = F.col(parent).isNull()
    state = rounds.store(edges.select(F.col(child).alias("id"), F.coalesce(parent, child).alias("live"), F.least(F.col(child), F.coalesce(parent, child)).alias("_low"), ended.alias("_end")))
    for _ in range(max_rounds):
        ahead = state.select(F.col("id").alias("_i"), F.col("live").alias("_next"), F.col("_low").alias("_l"), F.col("_end").alias("_e"))
        step = state.join(ahead, state["live"] == ahead["_i"], "left").withColumn("_lower", F.least("_low", F.coalesce("_l", "_low")))
        # an id that nothing leads on from is an end; what is on a cycle is settled once its low no longer falls
        moving = ~F.col("_end") & (F.coalesce("_e", F.lit(True)) | (F.col("_lower") < F.col("_low")))
        state = rounds.store(step.select("id", F.when(F.col("_end"), F.col("live")).otherwise(F.coalesce("_next", "live")).alias("live"), F.col("_lower").alias("_low"), (F.col("_end") | F.coalesce("_e", F.lit(True))).alias("_end"), moving.alias("_moving")))
        if not state.where("_moving").limit(1).count():
            return state.select("id", F.when(F.col("_end"), F.col("live")).otherwise(F.col("_low")).alias("live"))
        state = state.drop("_moving")
    raise RuntimeError(f"chains did not settle in {max_rounds} rounds")


def constituents(closed: DataFrame) -> DataFrame:
    """(live, constituents): how many ids each live one stands for, itself included."""
    return closed.groupBy("live").agg(F.count("*").alias("constituents"))


#: Edges from which a round stores what it joins them with, so that Spark can split a hub's edges; below, they are few enough to be sent.
HUB_EDGES = 5_000_000


def connected_components(pairs: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, component): smallest node of the component, for every node that has another as a neighbour.

    Alternating stars: every edge's larger end moves to the least neighbour of its smaller
    end, then all smaller neighbours of a node to the least of them, until only stars
    around the smallest nodes are left.  No node's neighbours are ever collected.  A large
    graph's rounds store what the edges are joined with, one row a node: Spark then splits
    the edges of a hub over tasks, which it can do only where both sides are exchanged as
    they are.
    """
    rounds = Rounds()
    ends = pairs.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("_up"), F.least(a, b).alias("_low"))
    edges = rounds.store(ends.distinct().withColumn("_moved", F.lit(True)))
    large = edges.count() > HUB_EDGES
    for _ in range(max_rounds):
        with Scratch() as scratch:
            keep = scratch if large else lambda df: df
            both = edges.select(F.col("_low").alias("_n"), F.col("_up").alias("_other")).unionByName(edges.select(F.col("_up").alias("_n"), F.col("_low").alias("_other")))
            near = keep(both.groupBy("_n").agg(F.min("_other").alias("_m")).where(F.col("_m") < F.col("_n")))
            joined = edges.drop("_moved").join(near, F.col("_low") == F.col("_n"), "left")
            up = keep(joined.select("_up", F.coalesce("_m", "_low").alias("_low"), F.col("_m").isNotNull().alias("_moved")).groupBy("_up", "_low").agg(F.max("_moved").alias("_moved")))
            least = keep(up.groupBy(F.col("_up").alias("_n")).agg(F.min("_low").alias("_m")))
            small = up.join(least, F.col("_up") == F.col("_n"))
            down = small.where(F.col("_low") > F.col("_m")).select(F.col("_low").alias("_up"), F.col("_m").alias("_low"), F.lit(True).alias("_moved"))
            own = small.select("_up", F.col("_m").alias("_low"), "_moved")
            edges = rounds.store(own.unionByName(down).groupBy("_up", "_low").agg(F.max("_moved").alias("_moved")))
        if not edges.where("_moved").limit(1).count():
            root = F.col("_low").alias("node")
            return edges.select(F.col("_up").alias("node"), F.col("_low").alias("component")).unionByName(edges.select(root, F.col("_low").alias("component")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def extended_components(known: DataFrame, pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of known components and more pairs: the pairs join components, whose members are only renamed."""
    label = lambda c, name: known.select(F.col("node").alias(f"_{name}"), F.col("component").alias(name))
    joined = pairs.select(F.col(a).alias("_a"), F.col(b).alias("_b")).where(F.col("_a") != F.col("_b")).join(label(known, "la").withColumnRenamed("_la", "_a"), "_a", "left").join(label(known, "lb").withColumnRenamed("_lb", "_b"), "_b", "left")
    joined, path = store_at(joined.select("_a", "_b", F.coalesce("la", "_a").alias("la"), F.coalesce("lb", "_b").alias("lb")))
    roots = connected_components(joined, "la", "lb").select(F.col("node").alias("_label"), F.col("component").alias("_root"))
    fresh = joined.select(F.col("_a").alias("node")).unionByName(joined.select(F.col("_b").alias("node"))).distinct().join(known.select("node"), "node", "left_anti")
    every = known.select("node", "component").unionByName(fresh.select("node", F.col("node").alias("component")))
    out = stored(every.join(roots, F.col("component") == F.col("_label"), "left").select("node", F.coalesce("_root", "component").alias("component")))
    delete(pairs.sparkSession, path)
    return out


#: Rows of a block that are paired in one task with as many others.
BLOCK_ROWS = 2000


def candidate_pairs(rows: DataFrame, keys: Column, key: str = "id", block_rows: int = BLOCK_ROWS, carry: Sequence[str] = ()) -> DataFrame:
    """Unordered pairs of ids that share one of a row's blocking keys, each pair once; with the carried columns of both as l_ and r_.

    A block of more than block_rows rows is cut into parts by a hash of the id, and every
    two of its parts are a block of their own, so none is one task's.  A pair is given by
    the smallest key that both have, which is why no pair has to be looked for twice.
    """
    own = F.array_sort(F.array_distinct(F.array_compact(keys)))
    held = F.struct(*carry) if carry else F.lit(None).cast("boolean")
    keyed = rows.select(F.col(key).alias("id"), own.alias("keys"), held.alias("_row")).distinct().select("id", "keys", "_row", F.explode("keys").alias("block"))
    large = keyed.groupBy("block").agg(F.count("*").alias("_n")).where(F.col("_n") > block_rows).select("block", F.ceil(F.col("_n") / block_rows).cast("int").alias("_parts"))
    dealt = keyed.join(large, "block", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))).withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int"))
    left = dealt.select("block", F.col("_part").alias("_i"), F.explode(F.sequence(F.col("_part"), F.col("_parts") - 1)).alias("_j"), F.col("id").alias("_a"), F.col("keys").alias("_ka"), F.col("_row").alias("_ra"))
    right = dealt.select("block", F.explode(F.sequence(F.lit(0), F.col("_part"))).alias("_i"), F.col("_part").alias("_j"), F.col("id").alias("_b"), F.col("keys").alias("_kb"), F.col("_row").alias("_rb"))
    met = left.join(right, ["block", "_i", "_j"]).where((F.col("_i") < F.col("_j")) & (F.col("_a") != F.col("_b")) | (F.col("_i") == F.col("_j")) & (F.col("_a") < F.col("_b")))
    first = F.col("_a") < F.col("_b")
    carried = [F.when(first, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}")).alias(f"{side}_{c}") for side, x, y in (("l", "_ra", "_rb"), ("r", "_rb", "_ra")) for c in carry]
    return met.where(F.col("block") == F.array_min(F.array_intersect("_ka", "_kb"))).select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), *carried)


_TOLD_BY = ("parcel", "address_key", "bare_key", "unit", "latitude", "longitude")


def blocked_signals(rows: DataFrame, keys: Column, key: str = "id", metres: float = 50.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """pair_signals of candidate_pairs: the rows travel with their blocks, so that no pair is exchanged."""
    return _signals(candidate_pairs(rows, keys, key, block_rows, _TOLD_BY), metres)


def _notes(*pairs: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(c, text) for c, text in pairs]), lambda x: x.isNotNull())


def pair_signals(pairs: DataFrame, rows: DataFrame, key: str = "id", metres: float = 50.0) -> DataFrame:
    """What the rows of each pair say about each other: parcel, address and place are agreed, disagreed or unknown.

    Rows have parcel, address_key, bare_key (the key without its unit), unit, latitude and
    longitude.  Units that both have and that differ are a disagreement whatever else
    the address says; a unit on one side only leaves it unknown.  `units_differ` marks
    the first; `agreed`, `conflicted` and `unknown` hold notes.
    """
    fields = (key, *_TOLD_BY)
    side = lambda p: rows.select(*[F.col(c).alias(f"{p}_{c}") for c in fields])
    joined = pairs.join(side("l"), F.col("a") == F.col(f"l_{key}")).join(side("r"), F.col("b") == F.col(f"r_{key}"))
    return _signals(joined, metres)


def _signals(joined: DataFrame, metres: float) -> DataFrame:
    l, r = (lambda c: F.col(f"l_{c}")), (lambda c: F.col(f"r_{c}"))  # noqa: E741
    apart = geo.haversine(l("latitude"), l("longitude"), r("latitude"), r("longitude"))
    known = geo.known_point(l("latitude"), l("longitude")) & geo.known_point(r("latitude"), r("longitude"))
    units_differ = F.coalesce(l("unit") != r("unit"), F.lit(False))
    parcel = F.when(l("parcel").isNull() | r("parcel").isNull(), "unknown").when(l("parcel") == r("parcel"), "agreed").otherwise("disagreed")
    address = (
        F.when(units_differ, "disagreed").when(l("address_key").isNull() | r("address_key").isNull(), "unknown").when(l("address_key") == r("address_key"), "agreed")
        .when(l("bare_key") == r("bare_key"), "unknown").otherwise("disagreed")
    )
    place = F.when(~known, "unknown").when(apart <= metres, "agreed").otherwise("disagreed")
    told = joined.select("a", "b", parcel.alias("parcel"), address.alias("address"), place.alias("place"), units_differ.alias("units_differ"), (l("parcel").isNotNull() | r("parcel").isNotNull()).alias("_some"), (l("bare_key") == r("bare_key")).alias("_bare"))
    is_ = lambda c, v: F.col(c) == v
    return told.select(
        "a", "b", "parcel", "address", "place", "units_differ",
        _notes((is_("parcel", "agreed"), "parcel"), (is_("address", "agreed"), "address"), (is_("place", "agreed"), "place")).alias("agreed"),
        _notes((is_("parcel", "disagreed"), "parcel"), (is_("address", "disagreed"), "address"), (is_("place", "disagreed"), "place")).alias("conflicted"),
        _notes((is_("parcel", "unknown") & F.col("_some"), "parcel on one side"), (is_("address", "unknown") & F.col("_bare"), "unit on one side"), (is_("address", "unknown") & ~F.coalesce("_bare", F.lit(False)), "no address"), (is_("place", "unknown"), "no coordinates")).alias("unknown"),
    )


def decide(signals: DataFrame) -> DataFrame:
    """Adds the decision: matched, distinct, ambiguous or unrelated; the first that applies.

    Parcels settle it both ways, whatever the addresses say.  Different units are
    distinct, other different addresses unrelated.  Equal addresses match, unless the
    coordinates contradict them: then it is a question.  Without an address coordinates
    that agree are a question, as they are never enough.
    """
    parcel, address, place = F.col("parcel"), F.col("address"), F.col("place")
    decision = (
        F.when(parcel == "agreed", "matched")
        .when(parcel == "disagreed", "distinct")
        .when(address == "disagreed", F.when(F.col("units_differ"), "distinct").otherwise("unrelated"))
        .when(address == "agreed", F.when(place == "disagreed", "ambiguous").otherwise("matched"))
        .when(place == "agreed", "ambiguous")
        .otherwise("unrelated")
    )
    return signals.withColumn("decision", decision)


#: Why records were joined.
BY_PERSON, BY_PARCEL, BY_RULES = "a person decided it", "the same parcel number", "address and place agree"


def merge_pass(decided: DataFrame, answered: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Merges and questions of one pass over decided pairs (a, b, decision, parcel, by_person, and the notes agreed and conflicted).

    merges: (component, members, join_signal), a group of matched records of which every
    pair matched.  questions: (members, agreed, conflicted, uncompared), sorted: every
    other group, whole, as one question, and each ambiguous pair of which neither record
    is in a group; with the notes of all its pairs, and how many of these nobody compared.
    What a person answered before is not asked again.  answered: (members), of any number,
    in any order.
    """
    decided = decided if "agreed" in decided.columns else decided.withColumns({c: F.array().cast("array<string>") for c in ("agreed", "conflicted")})
    held = stored(decided.where(F.col("decision") == "matched").select("a", "b", "by_person", "parcel"))  # few of the pairs, and read three times
    matched = held.select("a", "b")
    groups = connected_components(matched)
    complete = complete_groups(matched, groups)
    members = groups.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("members"))
    sure = F.col("by_person") | (F.col("parcel") == "agreed")
    inside = held.where(sure).join(groups, held["a"] == groups["node"])
    why = inside.groupBy("component").agg(F.min_by(F.when(F.col("by_person"), BY_PERSON).otherwise(BY_PARCEL), F.struct("a", "b")).alias("_why"))
    told = members.join(complete.select("component", "complete"), "component").join(why, "component", "left")
    merges = told.where("complete").select("component", "members", F.coalesce("_why", F.lit(BY_RULES)).alias("join_signal"))
    grouped = groups.select("node")
    other = groups.select(F.col("node").alias("_other"), F.col("component").alias("_component"))
    all_notes = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)  # noqa: E731  of a closed list
    compared = (
        decided.join(groups, decided["a"] == groups["node"]).join(other, (F.col("b") == F.col("_other")) & (F.col("component") == F.col("_component")))
        .groupBy("component").agg(all_notes("agreed"), all_notes("conflicted"), F.count("*").alias("_compared"))
    )
    n = F.size("members")
    open_ = told.where(~F.col("complete")).join(compared, "component", "left").select("members", "agreed", "conflicted", (n * (n - 1) / 2 - F.col("_compared")).cast("bigint").alias("uncompared"))
    loose = decided.where(F.col("decision") == "ambiguous").join(grouped, F.col("a") == F.col("node"), "left_anti").join(grouped, F.col("b") == F.col("node"), "left_anti")
    pairs = loose.select(F.array_sort(F.array("a", "b")).alias("members"), F.array_sort("agreed").alias("agreed"), F.array_sort("conflicted").alias("conflicted"), F.lit(0).cast("bigint").alias("uncompared"))
    questions = open_.unionByName(pairs)
    if answered is not None:
        questions = questions.join(answered.select(F.array_sort("members").alias("members")).distinct(), "members", "left_anti")
    return merges, questions


def merge_edges(merges: DataFrame, seq: int, decided_by: str = "automatic") -> DataFrame:
    """Edges (id, superseded_by, join_signal, decided_by, seq) that a merge appends: every member points at a new id, a digest of all."""
    new = F.concat(F.lit("m-"), F.substring(F.sha2(F.array_join(F.transform("members", lambda m: m.cast("string")), ",").cast("binary"), 256), 1, 16))
    return merges.select(F.explode(F.transform("members", lambda m: m.cast("string"))).alias("id"), new.alias("superseded_by"), "join_signal", F.lit(decided_by).alias("decided_by"), F.lit(seq).alias("seq"))


def unmerge_edges(edges: DataFrame, merged: str, seq: int) -> DataFrame:
    """Edges that take a merge back: its members stand for themselves again."""
    return current_edges(edges).where(F.col("superseded_by") == merged).select("id", F.lit(None).cast("string").alias("superseded_by"), F.lit("taken back").alias("join_signal"), F.lit("person").alias("decided_by"), F.lit(seq).alias("seq"))


def current_edges(edges: DataFrame) -> DataFrame:
    """The edge that holds of each id: the last one appended."""
    return edges.groupBy("id").agg(F.max_by(F.struct("superseded_by", "join_signal", "decided_by"), "seq").alias("_e")).select("id", "_e.*")


def resolve_on_write(rows: DataFrame, known: DataFrame, live: DataFrame) -> DataFrame:
    """Adds `entity` to new rows: the live entity that the same source knows by the same id, else by the same address.

    Both have source, source_id, address, unit and postal; known also entity and at, of
    which the newest counts.  The address is looked up only for rows without an id, among
    rows without one; a row with neither is nobody's.  live: (id, live).
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    place = F.concat_ws("\x1f", F.lit("at"), "source", text("address"), text("unit"), text("postal"))
    own = F.concat_ws("\x1f", F.lit("id"), "source", "source_id")
    asked = rows.withColumn("_key", F.when(~blank("source_id"), own).when(~blank("address"), place))
    held = known.withColumn("_key", F.when(F.col("source_id").isNotNull(), own).otherwise(place)).groupBy("_key").agg(F.max_by("entity", "at").alias("_found"))
    found = asked.join(held, "_key", "left").join(live.select(F.col("id").alias("_found"), F.col("live").alias("_live")), "_found", "left")
    return found.select(*rows.columns, F.coalesce("_live", "_found").alias("entity"))


def override(decided: DataFrame, verdicts: DataFrame) -> DataFrame:
    """People's latest verdict on a pair wins; `contradicted` marks where it differs, `by_person` where there is one.  verdicts: a, b, verdict, seq."""
    last = verdicts.groupBy("a", "b").agg(F.max_by("verdict", "seq").alias("_verdict"))
    joined = decided.join(last, ["a", "b"], "left")
    said = F.col("_verdict").isNotNull()
    notes = [c for c in ("agreed", "conflicted") if c in decided.columns]
    return joined.select("a", "b", F.coalesce("_verdict", "decision").alias("decision"), (said & (F.col("_verdict") != F.col("decision"))).alias("contradicted"), "parcel", said.alias("by_person"), *notes)


def complete_groups(matched: DataFrame, components: DataFrame) -> DataFrame:
    """(component, members, pairs, complete): a group merges only if every pair of it matched."""
    size = components.groupBy("component").agg(F.count("*").alias("members"))
    pairs = matched.join(components, matched["a"] == components["node"]).groupBy("component").agg(F.count("*").alias("pairs"))
    return size.join(pairs, "component").withColumn("complete", F.col("pairs") == F.col("members") * (F.col("members") - 1) / 2)


def fullest(rows: DataFrame, live: str, filled: Sequence[str], arrival: str, flags: str | None = None) -> DataFrame:
    """One row for each live id: the one with the most known fields, then the most flags, of several the first to arrive."""
    known = sum((F.col(c).isNotNull().cast("int") for c in filled), F.lit(0))
    raised = F.coalesce(F.col(flags), F.lit(0)) if flags else F.lit(0)
    best = rows.groupBy(F.col(live).alias("_live")).agg(F.min_by(F.struct(*rows.columns), F.struct((-known).alias("k"), (-raised).alias("f"), F.col(arrival).alias("a"))).alias("_row"))
    return best.select("_row.*")
