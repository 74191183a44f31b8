"""Texts that stop before their end.

Evidence, each a column of its own:

* ``prefix``: the final token is no word of the corpus but a proper prefix of one. The
  vocabulary trie is a table of its nodes (every prefix of every known word, those of more
  than ``DEPTH`` characters kept whole in the node where they part), so the look-up of all
  final tokens is one join and no node set has to fit anywhere.
* ``hanging``: the final token is a word of the corpus that hardly ever ends a line (in less
  than one of ``RARE`` texts that hold it), or its line has run on for ``RUN_ON`` characters,
  as no heading does: the text stops inside a sentence, after a whole word.
* ``limit``: length evidence. The text has just the length, in characters or bytes, at which
  its origin cuts: the longest of the origin, and reached by several texts.
* ``mark``: it ends in a cut mark (dots, ``[truncated]``, a broken character or escape).
* ``open``: an ending without a letter that neither ends a sentence nor closes a block, or
  a fence or JSON document that is never closed.
* ``missing``: a sectioned note without its last section.
* ``stopped``: length evidence. The stop reason, in any spelling, is the token limit.

The trie decides every text that ends in a letter: it is cut if its final token is an
unknown prefix, or a word that hangs (unless the line is a heading); without a trie such a
text is whole, unless length, a mark or the missing sections tell. Empty texts, and turns
without text whose stop isn't the token limit, are not cut. Null texts, null arrays,
unknown origins and empty tables give no rows; a record that was delivered twice counts
once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteglass.session import materialise, table

#: The sections of a note, in the languages of the prompts; the last of each list is the last section.
SECTIONS = {
    "en": ["changed this session", "ruled out", "still undecided", "watch out"],
    "de": ["geändert", "verworfen", "noch offen", "fallstricke"],
    "fr": ["modifié", "écarté", "à trancher", "pièges"],
    "es": ["cambios", "descartado", "por decidir", "trampas"],
}
#: Spellings of the token limit as a stop reason, and as a message.
LIMIT_STOPS = ["max_tokens", "length", "max_output_tokens", "token_limit"]
LIMIT_MESSAGE = r"(?i)max_?tokens|ceiling|output limit|token limit|partial (turn|note)"
MARK = r"(…|\.\.\.|\[(truncated|snipped|cut)\]|<(snip|truncated|cut)>|\[\.\.\. ?\d+ more \w+\]|�|\\u[0-9a-fA-F]{0,3}|\\)\s*\z"
#: Fewest texts that must end at an origin's longest length for it to count as a limit.
LEAST = 3
#: A section's heading in lower-case text: any mark-up around any of the names, alone on its line.
_NAMES = "(?:" + "|".join(n for names in SECTIONS.values() for n in names) + ")"
_LAST_NAMES = "(?:" + "|".join(names[-1] for names in SECTIONS.values()) + ")"
ANY_SECTION = rf"(?:\A|\n)[ \t>#*]*{_NAMES}[ \t*:]*(?=\n|\z)"
LAST_SECTION = rf"(?:\A|\n)[ \t>#*]*{_LAST_NAMES}[ \t*:]*(?=\n|\z)"
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85" + "".join(map(chr, (0xA0, 0x2028, 0x2029, 0x200B, 0xFEFF)))
WIDE_STOPS = "".join(map(chr, (0x3002, 0xFF01, 0xFF1F)))
CLOSERS = "".join(map(chr, (0x201D, 0x2019)))
#: Depth of the trie; longer words stay whole in their node of this depth.
DEPTH = 40
#: A word that ends a line in fewer than one of this many texts hangs; a last line of this many characters runs on.
RARE, RUN_ON = 50, 60
MOST_ORIGINS = 10_000


def is_limit(reason: Column) -> Column:
    return F.coalesce(F.lower(F.trim(reason)).isin(LIMIT_STOPS), F.lit(False))


def values(spark: SparkSession, folder: str) -> DataFrame:
    """(src, rec_id, pos, origin, stop, message, last, text): notes, and turns that have a text or a stop reason."""
    notes = table(spark, folder, "distillations").select(
        F.lit("distillations").alias("src"), F.col("dist_id").alias("rec_id"), F.lit(0).alias("pos"), "origin", F.col("stop_reason").alias("stop"), F.lit(None).cast("string").alias("message"), F.lit(True).alias("last"), F.col("note").alias("text")
    )
    failed = table(spark, folder, "attack_failures")
    most = F.greatest(F.coalesce(F.size("turns"), F.lit(0)), F.coalesce(F.size("stop_reasons"), F.lit(0)))
    turns = failed.select("failure_id", "origin", "message", "turns", "stop_reasons", most.alias("n")).where("n > 0")
    turns = turns.select("*", F.explode(F.sequence(F.lit(1), "n")).alias("pos")).select(
        F.lit("attack_failures").alias("src"), F.col("failure_id").alias("rec_id"), "pos", "origin", F.get("stop_reasons", F.col("pos") - 1).alias("stop"), "message", (F.col("pos") == F.col("n")).alias("last"), F.get("turns", F.col("pos") - 1).alias("text")
    )
    return notes.unionByName(turns)


def ends(rows: DataFrame) -> DataFrame:
    """What each text shows by itself, in narrow columns; the text is read once and left behind."""
    line = lambda c: F.substring_index(c, "\n", -1)
    bare = F.rtrim(F.coalesce("text", F.lit("")), F.lit(BLANKS))
    end = rows.withColumn("bare", bare).withColumn("mark", line("bare").rlike(MARK))
    low = end.withColumn("core", line(F.when(F.col("mark"), F.rtrim(F.regexp_replace("bare", MARK, ""), F.lit(BLANKS))).otherwise(F.col("bare")))).withColumn("low", F.lower("bare"))
    heading = F.lower("core").rlike(ANY_SECTION) | F.col("core").rlike(r"^\s*([-=]{3,}|#{1,6} .*|\*\*[^*]+\*\*)\s*$")
    note = F.col("src") == "distillations"
    # a turn that is a JSON document is closed by its last bracket only
    counts = lambda c: F.length("bare") - F.length(F.replace("bare", F.lit(c), F.lit("")))
    document = ~note & F.col("bare").rlike(r"\A\s*[{\[]")
    balanced = F.col("core").rlike(r"[}\]]\z") & (counts("{") == counts("}")) & (counts("[") == counts("]"))
    closed, whole = "[.!?" + WIDE_STOPS + ")\\]}\"'`|" + CLOSERS + "]\\z", "[.!?" + WIDE_STOPS[0] + "]\\z"
    return low.select(
        "src", "rec_id", "pos", "origin", "stop", "message", "last", F.col("text").isNull().alias("absent"), F.length("text").alias("n_chars"), F.octet_length("text").alias("n_bytes"), (F.length("bare") > 0).alias("kept"), "mark",
        F.regexp_extract("core", r"(\p{L}+)\z", 1).alias("token"), F.length("core").alias("n_line"), heading.alias("heading"), F.col("bare").rlike(r"\p{L}{2}|\p{N}").alias("wordy"), F.when(document, balanced).otherwise(F.col("core").rlike(closed)).alias("closed"), F.col("core").rlike(whole).alias("whole"),
        F.regexp_count("bare", F.lit(r"(?m)^[ \t>]*```")).alias("fences"), F.when(note, F.regexp_count("low", F.lit(ANY_SECTION))).otherwise(0).alias("sections"), (note & F.col("low").rlike(LAST_SECTION)).alias("full"),
    )


def limits(local: DataFrame) -> DataFrame:
    """(origin, most_chars, most_bytes): null where the longest length isn't a limit.

    local: rows of ``ends``. A record that was delivered twice adds two to a length, which
    is under ``LEAST``.
    """
    counted = local.where("origin is not null and kept").groupBy("origin", "n_chars", "n_bytes").agg(F.count("*").alias("k"))

    def at(measure: str, name: str) -> DataFrame:
        top = counted.groupBy("origin", measure).agg(F.sum("k").alias("k")).groupBy("origin").agg(F.max(F.struct(measure, "k")).alias("top"))
        return top.select("origin", F.when(F.col("top.k") >= LEAST, F.col(f"top.{measure}")).alias(name))

    return at("n_chars", "most_chars").join(at("n_bytes", "most_bytes"), "origin", "full_outer")


def with_limits(local: DataFrame, base: DataFrame) -> DataFrame:
    """The rows with the limits of their origin, found in base.

    Origins are stores; while they are few, as is checked, their limits are constants of the plan.
    """
    own = limits(base).where("most_chars is not null or most_bytes is not null")
    got = own.limit(MOST_ORIGINS + 1).collect()
    if len(got) > MOST_ORIGINS:
        return local.join(own, "origin", "left")
    if not got:
        return local.withColumn("most_chars", F.lit(None).cast("int")).withColumn("most_bytes", F.lit(None).cast("int"))
    pairs = [F.lit(x) if isinstance(x, str) else F.struct(F.lit(x[0]).cast("int").alias("c"), F.lit(x[1]).cast("int").alias("b")) for r in got for x in (r.origin, (r.most_chars, r.most_bytes))]
    found = F.try_element_at(F.create_map(*pairs), F.col("origin"))
    return local.withColumn("most_chars", found["c"]).withColumn("most_bytes", found["b"])


def words(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, n, ended): every word of the corpus, the number of texts that hold it before something else, and of those where it ends a line.

    The final token of a text isn't counted: it may be cut.
    """
    pieces = texts.where(f"length({text}) > 0").select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\p{L}+(?:\n|(?=[^\p{L}]))"), F.lit(0)))).alias("piece"))
    word = F.rtrim("piece", F.lit("\n"))
    return pieces.select(word.alias("word"), F.endswith("piece", F.lit("\n")).alias("ended")).where("length(word) > 1").groupBy("word").agg(F.count("*").alias("n"), F.count_if("ended").alias("ended"))


def trie(vocabulary: DataFrame, least: int = 2) -> DataFrame:
    """(node, below, is_word, rare): nodes of the trie, to its depth, of all words that occur at least that often."""
    known = vocabulary.where(F.col("n") >= least)
    nodes = known.select("word", (F.col("ended") * RARE < F.col("n")).alias("rare"), F.explode(F.expr(f"transform(sequence(1, least(length(word), {DEPTH})), k -> left(word, k))")).alias("node"))
    own = F.col("node") == F.col("word")
    return nodes.groupBy("node").agg(F.count_if(~own).alias("below"), F.bool_or(own).alias("is_word"), F.bool_or(own & F.col("rare")).alias("rare"))


def look_up(tokens: DataFrame, vocabulary: DataFrame, least: int = 2) -> DataFrame:
    """(token, prefix, is_word, rare) of distinct tokens: an unknown proper prefix of a word; a word; one that hardly ends lines.

    A token longer than the trie is deep is compared with the words kept whole in its node.
    """
    short = tokens.where(F.length("token") <= DEPTH).join(trie(vocabulary, least).withColumnRenamed("node", "token"), "token")
    leaf = lambda c: F.left(F.col(c), F.lit(DEPTH))
    kept = vocabulary.where((F.col("n") >= least) & (F.length("word") > DEPTH)).select("word", (F.col("ended") * RARE < F.col("n")).alias("rare"), leaf("word").alias("leaf"))
    long = tokens.where(F.length("token") > DEPTH).withColumn("leaf", leaf("token")).join(kept, "leaf").where(F.startswith("word", "token"))
    same = F.col("word") == F.col("token")
    deep = long.groupBy("token").agg(F.count_if(~same).alias("below"), F.bool_or(same).alias("is_word"), F.bool_or(same & F.col("rare")).alias("rare"))
    return short.unionByName(deep).select("token", ((F.col("below") > 0) & ~F.col("is_word")).alias("prefix"), "is_word", "rare")


def evidence(rows: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(src, rec_id, pos, origin, all evidence, cut) of rows as ``values`` gives them.

    vocabulary: words as ``words`` counts them; those of the texts themselves unless given.
    Texts are scanned twice, for their ends and for the vocabulary; everything that is
    joined is a few narrow columns.
    """
    local = materialise(ends(rows), "ends")
    tokens = local.where("length(token) > 0").select("token").distinct()
    told = look_up(tokens, words(rows) if vocabulary is None else vocabulary).where("prefix or is_word")
    # the empty token, which most rows have, stays out of the join: it would all go to one task
    asked = local.where("length(token) > 0").join(told, "token", "left")
    joined = with_limits(asked.unionByName(local.where("length(token) = 0"), allowMissingColumns=True), local)

    prefix, hanging, note = F.coalesce("prefix", F.lit(False)), F.coalesce(F.col("is_word") & (F.col("rare") | (F.col("n_line") >= RUN_ON)), F.lit(False)) & ~F.col("heading"), F.col("src") == "distillations"
    lettered = F.col("token") != ""
    opened = F.col("wordy") & ((F.col("fences") % 2 == 1) | (~F.col("closed") & ~F.col("heading") & ~lettered))
    broken = F.col("wordy") & ~F.col("closed") & (prefix | hanging)
    limit = F.coalesce(F.col("n_chars") == F.col("most_chars"), F.lit(False)) | F.coalesce(F.col("n_bytes") == F.col("most_bytes"), F.lit(False))
    at_limit = is_limit(F.col("stop"))
    spoken = F.col("stop").isNull() & F.col("last") & F.coalesce(F.col("message").rlike(LIMIT_MESSAGE), F.lit(False))
    dropped = F.col("absent") & ~note & (at_limit | spoken)
    # a complete note, or a complete sentence outside one, that only quotes a mark at its end
    normal_stop = F.coalesce(F.lower(F.trim("stop")).isin("end_turn", "stop_sequence"), F.lit(False))
    quoted = F.col("whole") & F.when(note, F.col("full") & (F.col("fences") % 2 == 0)).otherwise(normal_stop)
    missing = note & (F.col("sections") >= 2) & ~F.col("full")
    return joined.select(
        "src", "rec_id", "pos", "origin", "stop", "token", prefix.alias("prefix"), hanging.alias("hanging"), limit.alias("limit"), "mark", (opened & F.col("kept")).alias("open"), missing.alias("missing"), at_limit.alias("stopped"),
        (dropped | (F.col("kept") & F.col("wordy") & ((F.col("mark") & ~quoted) | limit | opened | broken | missing | at_limit))).alias("cut"),
    )


def cut_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(src, rec_id, pos) of every cut text, once."""
    return evidence(values(spark, folder)).where("cut").select("src", "rec_id", "pos").distinct()


def shares(spark: SparkSession, folder: str) -> DataFrame:
    """(src, origin, n_records, n_cut, share): how often each origin truncates, by record."""
    rows = evidence(values(spark, folder)).groupBy("src", "origin", "rec_id").agg(F.bool_or("cut").alias("cut"))
    whole = rows.groupBy("src", "origin").agg(F.count("*").alias("n_records"), F.count_if("cut").alias("n_cut"))
    none = table(spark, folder, "attack_failures").where("coalesce(size(turns), 0) <= 0 and coalesce(size(stop_reasons), 0) <= 0")
    none = none.groupBy(F.lit("attack_failures").alias("src"), "origin").agg(F.count_distinct("failure_id").alias("n_records"), F.lit(0).cast("bigint").alias("n_cut"))
    both = whole.unionByName(none).groupBy("src", "origin").agg(F.sum("n_records").alias("n_records"), F.sum("n_cut").alias("n_cut"))
    return both.withColumn("share", F.round(F.col("n_cut") / F.col("n_records"), 6))
