"""Match rules: tags and correspondents against document text.

Rules belong to a tenant.  They are prepared once (folded words, checked regexes) and packed: a document
meets its tenant's unlike rules as one array, so its text is in the join once, not once per rule, and one pass
tells all that match.  Rules that say the same are read once and told apart after the match.  A pack is bounded;
a tenant with more rules has several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import bind
from ..session import materialise


def fold(text: Column) -> Column:
    """Case folding: also ``ß`` and ``SS`` are equal."""
    return F.lower(F.upper(text))


def rule_text(title: Column, text: Column, cap: int | None = None) -> Column:
    """Title, a blank and the text; all of it, or its first ``cap`` characters."""
    joined = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))
    return joined if cap is None else F.substring(joined, 1, cap)


def checked_regex(pattern: Column) -> Column:
    """The pattern if it compiles, else NULL (an invalid rule matches nothing)."""
    compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern)
    return F.when(compiled.isNotNull(), pattern)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Active rules with folded pattern, its words and a safe regex."""
    active = rules.filter((F.col("matching_algorithm") != "none") & (F.col("match") != ""))
    folded = F.when(F.col("is_insensitive"), fold(F.col("match"))).otherwise(F.col("match"))
    regex = F.when(
        F.col("matching_algorithm") == "regex",
        checked_regex(F.concat(F.when(F.col("is_insensitive"), "(?iu)").otherwise(""), F.col("match"))),
    )
    return active.withColumns(
        {
            "rule_folded": folded,
            "rule_words": F.filter(F.split(folded, r"(?U)\s+"), lambda w: w != ""),
            "rule_regex": regex,
        }
    ).withColumn("rule_key", F.to_json(F.struct("matching_algorithm", "is_insensitive", "rule_folded", "rule_regex")))


#: Rules in one array; a text is read again only for every so many rules of its tenant.
PACK = 1_000
_RULE = ("matching_algorithm", "is_insensitive", "rule_folded", "rule_words", "rule_regex")


def rule_packs(prepared: DataFrame, *place: Column) -> DataFrame:
    """(tenant_id, rules): a tenant's unlike rules, in the order of ``place`` if given, in arrays of at most ``PACK``."""
    unlike = prepared.groupBy("tenant_id", "rule_key").agg(*place, *[F.first(c).alias(c) for c in _RULE])
    columns = [*unlike.columns[2 : 2 + len(place)], "rule_key", *_RULE]
    number = F.row_number().over(Window.partitionBy("tenant_id").orderBy(*columns[: len(place) + 1]))
    numbered = unlike.withColumn("_pack", F.floor((number - 1) / PACK))
    rules = F.array_sort(F.collect_list(F.struct(*columns))).alias("rules")
    return numbered.groupBy("tenant_id", "_pack").agg(rules).drop("_pack")


def _tag_lists(prepared: DataFrame) -> DataFrame:
    """(tenant_id, rule_key, tag_ids): the tags of rules that say the same, in arrays of at most ``PACK``."""
    place = F.row_number().over(Window.partitionBy("tenant_id", "rule_key").orderBy("tag_id"))
    numbered = prepared.select("tenant_id", "rule_key", "tag_id", F.floor((place - 1) / PACK).alias("_list"))
    # The struct keeps a rule without id in the list.
    ids = F.transform(F.collect_list(F.struct("tag_id")), lambda t: t["tag_id"]).alias("tag_ids")
    return numbered.groupBy("tenant_id", "rule_key", "_list").agg(ids).drop("_list")


def rule_hit(rule: Column, text: Column, folded_text: Column) -> Column:
    """Does a prepared rule match the text?  Unknown algorithms never do."""
    haystack = F.when(rule["is_insensitive"], folded_text).otherwise(text)
    words, kind = rule["rule_words"], rule["matching_algorithm"]
    some = F.size(words) > 0
    return F.coalesce(
        F.when(kind == "any", some & F.exists(words, lambda w: F.contains(haystack, w)))
        .when(kind == "all", some & F.forall(words, lambda w: F.contains(haystack, w)))
        .when(kind == "literal", F.contains(haystack, rule["rule_folded"]))
        .when(kind == "regex", F.rlike(text, rule["rule_regex"])),
        F.lit(False),
    )


def _texts(docs: DataFrame, cap: int | None, *extra: str) -> DataFrame:
    body = rule_text(F.col("title"), F.col("text"), cap)
    return docs.select("id", "tenant_id", *extra, body.alias("rule_text")).withColumn("folded_text", fold(F.col("rule_text")))


def _matches(docs: DataFrame, tags: DataFrame, cap: int | None) -> DataFrame:
    """(document_id, tag_ids): the tags of every rule that matches, rules that say the same as arrays."""
    prepared = prepare_rules(tags).withColumnRenamed("id", "tag_id")
    joined = _texts(docs, cap).join(rule_packs(prepared), "tenant_id")
    hits = F.filter("rules", lambda r: rule_hit(r, F.col("rule_text"), F.col("folded_text")))
    found = joined.select(F.col("id").alias("document_id"), "tenant_id", F.explode(F.transform(hits, lambda r: r["rule_key"])).alias("rule_key"))
    return found.join(_tag_lists(prepared), ["tenant_id", "rule_key"]).select("document_id", "tag_ids")


def match_tags(docs: DataFrame, tags: DataFrame, cap: int | None = None) -> DataFrame:
    """(document_id, tag_id) for every tag rule that matches.

    Input: docs(id, tenant_id, title, text).  ``cap=None`` reads whole texts.
    """
    return _matches(docs, tags, cap).select("document_id", F.explode("tag_ids").alias("tag_id"))


def vendor_name_hits(docs: DataFrame, correspondents: DataFrame) -> DataFrame:
    """(id, correspondent_id) where the trimmed vendor is a correspondent's name, whatever the case."""
    names = correspondents.select("tenant_id", fold(F.col("name")).alias("_name"), F.col("id").alias("correspondent_id"))
    return docs.select("id", "tenant_id", fold(F.btrim("vendor")).alias("_name")).join(names, ["tenant_id", "_name"]).select("id", "correspondent_id")


def match_correspondents(docs: DataFrame, correspondents: DataFrame, cap: int | None = None) -> DataFrame:
    """First correspondent per document by rule or by equal vendor name.

    Input: docs(id, tenant_id, title, text, vendor).  Rules are tried in creation
    order.
    """
    prepared = prepare_rules(correspondents).withColumns({"place": F.struct("created_at", "id"), "rule_name": fold(F.col("name"))})
    # Of rules that say the same, and of equal names, only the first can be the first hit.
    joined = _texts(docs, cap).join(rule_packs(prepared, F.min("place").alias("place")), "tenant_id")
    none = F.lit(None).cast(prepared.schema["place"].dataType)
    # The rules stand in order: after the first hit none is tried.
    first = F.aggregate(
        "rules",
        none,
        lambda hit, r: F.when(hit.isNotNull(), hit).when(rule_hit(r, F.col("rule_text"), F.col("folded_text")), r["place"]),
    )
    by_rule = joined.select("id", first.alias("place")).filter("place IS NOT NULL")
    names = prepared.groupBy("tenant_id", "rule_name").agg(F.min("place").alias("place"))
    by_name = docs.select("id", "tenant_id", fold(F.btrim("vendor")).alias("rule_name")).join(names, ["tenant_id", "rule_name"]).select("id", "place")
    # A tenant with several packs has a first hit in each.
    found = by_rule.unionByName(by_name).groupBy("id").agg(F.min("place").alias("place"))
    return found.select("id", F.col("place.id").alias("correspondent_id"))


# -- email senders ---------------------------------------------------------------


def parse_sender(text: Column) -> Column:
    """Struct of display name and lower-case address from the first From line."""
    blank_to_null = lambda c: F.when(F.btrim(c) != "", F.btrim(c))

    def parts(line: Column) -> Column:
        angle = F.regexp_extract(line, r"<([^<>]*)>", 1)
        comment = F.regexp_extract(line, r"^([^\s<>()]+)\s*\(([^()]*)\)$", 1)
        return bind(F.struct(line.alias("line"), angle.alias("angle"), comment.alias("comment")), read)

    def read(p: Column) -> Column:
        line, angle, comment = p["line"], p["angle"], p["comment"]
        before = F.btrim(F.regexp_extract(line, r"^([^<]*)<", 1))
        unquoted = F.regexp_replace(before, r'^"(.*)"$', "$1")
        # Without brackets the first word is taken as the address.
        bare = F.regexp_extract(line, r"^([^\s<>()]+)", 1)
        name = F.when(angle != "", unquoted).when(comment != "", F.regexp_extract(line, r"\(([^()]*)\)$", 1))
        address = F.when(angle != "", angle).when(comment != "", comment).otherwise(bare)
        return F.struct(blank_to_null(name).alias("name"), F.lower(blank_to_null(address)).alias("email"))

    return bind(F.btrim(F.regexp_extract(text, r"(?m)^From:\s*([^\n]+)", 1), F.lit(" \t\r")), parts)


def link_senders(senders: DataFrame, correspondents: DataFrame) -> DataFrame:
    """Get-or-create correspondents for a batch of senders.

    Input: senders(id, tenant_id, name, email).  Output: one row per sender with
    ``correspondent_id`` (existing) or ``new_name`` (to be created) and
    ``fill_email``: the address the correspondent gains, if any.

    Order of attempts: known address; known display name (whose missing address is
    filled); a new correspondent under the display name.  Among senders of one
    batch the earliest id decides which address a correspondent gets, and later
    senders with that address join it.
    """
    shown = F.btrim(F.coalesce("name", "email"))
    batch = senders.select("id", "tenant_id", "email", shown.alias("display"))
    by_email = correspondents.filter(F.col("email").isNotNull()).groupBy("tenant_id", "email").agg(
        F.min("id").alias("email_id")
    )
    by_name = correspondents.groupBy("tenant_id", F.col("name").alias("display")).agg(
        F.min_by(F.struct("id", "email"), "id").alias("named")
    )
    known = batch.join(by_email, ["tenant_id", "email"], "left").join(by_name, ["tenant_id", "display"], "left")
    # Only senders without a known address can claim one.
    open_target = F.col("email_id").isNull() & (F.col("named").isNull() | F.col("named.email").isNull())
    claims = (
        known.filter(open_target)
        .groupBy("tenant_id", "display")
        .agg(F.min_by(F.struct("id", "email"), "id").alias("c"), F.min("named.id").alias("claimed_id"))
    )
    owner = claims.groupBy("tenant_id", F.col("c.email").alias("email")).agg(
        F.min_by(F.struct(F.col("display"), F.col("claimed_id")), F.col("c.id")).alias("owner")
    )
    joined = known.join(owner, ["tenant_id", "email"], "left")
    by_owner = F.col("email_id").isNull() & F.col("owner").isNotNull()
    existing = F.when(by_owner, F.col("owner.claimed_id")).otherwise(F.coalesce("email_id", F.col("named.id")))
    new_name = F.when(
        existing.isNull(), F.when(by_owner, F.col("owner.display")).otherwise(F.col("display"))
    )
    return joined.select(
        "id",
        "tenant_id",
        "email",
        existing.alias("correspondent_id"),
        new_name.alias("new_name"),
        F.when(by_owner, F.col("email")).alias("fill_email"),
    )


def new_correspondents(links: DataFrame) -> DataFrame:
    """One row per correspondent to create; its address is the claimed one."""
    fresh = links.filter(F.col("new_name").isNotNull())
    return fresh.groupBy("tenant_id", F.col("new_name").alias("name")).agg(
        F.coalesce(F.min("fill_email"), F.min_by("email", "id")).alias("email")
    )


def assign_correspondent(
    docs: DataFrame, correspondents: DataFrame, email_type: str = "message/rfc822", cap: int | None = None
) -> DataFrame:
    """Correspondent for documents that have none.

    Email documents with a sender address go by the sender; the others by rule or
    vendor name.  Output: id, correspondent_id, new_name, source.
    """
    open_docs = docs.filter(F.col("correspondent_id").isNull())
    sender = F.when(F.col("mime_type") == email_type, parse_sender(F.col("text")))
    # A one-row generator: the sender is read once, whatever filters on it.
    marked = open_docs.select("*", F.explode(F.array(sender)).alias("_sender"))
    is_mail = F.coalesce(F.col("_sender.email").isNotNull(), F.lit(False))
    # Senders meet each other several times: written once, without the texts.
    mails = materialise(docs.sparkSession, marked.filter(is_mail).select("id", "tenant_id", "_sender.name", "_sender.email"), "senders")
    linked = link_senders(mails, correspondents).select("id", "correspondent_id", "new_name", F.lit("sender").alias("source"))
    others = marked.filter(~is_mail).drop("correspondent_id")
    matched = match_correspondents(others, correspondents, cap).select(
        "id", "correspondent_id", F.lit(None).cast("string").alias("new_name"), F.lit("rule").alias("source")
    )
    return linked.unionByName(matched)


def apply_rules_to_existing(
    docs: DataFrame, tags: DataFrame, correspondents: DataFrame, document_tags: DataFrame, cap: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Re-run all rules over live documents; running it twice changes nothing more.

    Returns the completed bridge and the correspondent links of documents that
    had none.
    """
    live_docs = docs.filter(F.col("deleted_at").isNull())
    # The tags of a document stay one array through the shuffle; pairs are told apart inside it.
    given = document_tags.select("document_id", F.array("tag_id").alias("tag_ids"))
    whole = _matches(live_docs, tags, cap).unionByName(given).groupBy("document_id").agg(F.array_distinct(F.flatten(F.collect_list("tag_ids"))).alias("tag_ids"))
    return whole.select("document_id", F.explode("tag_ids").alias("tag_id")), assign_correspondent(live_docs, correspondents, cap=cap)
