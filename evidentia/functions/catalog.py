"""The signal catalogue: a dimension table of signals, their categories, directions and log-odds weights."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Signal, direction and weight; the prefix names the category.
_SIGNALS = """
fp.lovable ai 4.5
fp.bolt ai 4.5
fp.v0 ai 4.5
fp.replit ai 4.2
fp.base44 ai 4.5
fp.generator_meta ai 4.0
fp.builder_other ai 4.0
gh.big_bang ai 1.4
gh.velocity ai 1.2
gh.micro_fix_trail ai 1.1
gh.prompt_messages ai 1.0
gh.single_session ai 0.9
gh.generic_messages ai 0.6
gh.steady_cadence human 1.1
gh.multiple_authors human 1.0
gh.merges_and_reverts human 0.8
gh.issue_refs human 0.8
gh.human_mess human 0.7
xs.template_uniformity ai 1.2
xs.placeholder_pages ai 0.9
xs.sitemap_one_pass ai 0.7
xs.uniform_page_size ai 0.7
xs.style_drift human 1.0
xs.varied_pages human 0.8
xs.sitemap_history human 0.8
xs.deep_content human 0.7
st.section_comments ai 1.1
st.uniform_comment_density ai 1.0
st.docblock_on_everything ai 0.9
st.import_block_sorted ai 0.6
st.multiple_solutions ai 1.0
st.dead_code ai 0.8
st.untouched_scaffold ai 0.95
st.generated_stack ai 0.7
st.client_only_backend ai 0.6
st.spa_shell ai 0.45
st.file_header_block ai 0.6
st.full_scaffold ai 0.35
cd.emoji_comments ai 1.3
cd.assistant_chatter ai 1.4
cd.emoji_logging ai 1.1
cd.what_comments ai 1.0
cd.empty_tests ai 0.9
cd.blanket_try ai 0.8
cd.swallowed_errors ai 0.8
cd.section_header_comments ai 0.7
cd.verbose_names ai 0.6
cd.formal_errors ai 0.6
cd.typography ai 0.6
cd.generic_domain_names ai 0.8
cd.placeholder_endpoint ai 0.8
cd.tautological_params ai 0.7
cd.mixed_conventions ai 0.7
cd.ceremony_for_nothing ai 0.6
cd.defensive_chaining ai 0.5
cd.over_symmetric_branches ai 0.45
cd.lazy_names ai 0.5
cd.console_noise ai 0.5
cd.helper_pileup ai 0.5
cd.todo_placeholders ai 0.5
cd.main_guard ai 0.4
ct.generic_names ai 0.7
ct.emoji_icons ai 0.6
ct.marketing_cliche ai 0.5
ct.stat_inflation ai 0.5
ct.pricing_three ai 0.35
ct.placeholder_copy ai 0.5
ct.dead_links ai 0.4
se.placeholder_secret ai 0.9
se.weak_auth ai 0.7
se.insecure_defaults ai 0.6
se.exposed_client_key ai 0.85
se.client_side_auth ai 0.65
ae.indigo ai 0.45
ae.shadcn_defaults ai 0.40
ae.left_border_card ai 0.40
ae.gradient_text ai 0.40
ae.glassmorphism ai 0.30
ae.hero_pill ai 0.50
ae.scroll_indicator ai 0.45
ae.glow_orbs ai 0.40
ae.bento_grid ai 0.40
ae.logo_marquee ai 0.40
ae.floating_nav ai 0.35
ae.lucide ai 0.35
ae.three_cards ai 0.30
ae.inter_font ai 0.30
ae.uniform_whitespace ai 0.25
ae.no_real_images ai 0.25
hu.why_comments human 1.0
hu.ticket_refs human 0.9
hu.informal human 0.9
hu.typos human 0.7
hu.operational_stack human 0.6
hu.dated_copyright human 0.4
hu.long_tail_copy human 0.5
hu.cms human 0.7
hu.hardened_headers human 0.45
hu.inconsistent_format human 0.6
hu.commented_code human 0.5
hu.legacy_stack human 0.5
hu.abbrevs human 0.4
hu.build_stripped human 0.2
hu.real_media human 0.4
"""
# Category of each prefix, its label, and the most that one direction of it can add (None: no limit).
_CATEGORIES = {
    "fp": ("fingerprint", "Platform fingerprint", None),
    "gh": ("history", "Repository history", "3.2"),
    "xs": ("sitewide", "Site-wide", "2.2"),
    "st": ("structure", "Structural", "2.6"),
    "cd": ("code", "Code style", "2.8"),
    "ct": ("content", "Content", "1.4"),
    "se": ("security", "Security profile", "1.6"),
    "ae": ("aesthetic", "Aesthetic", "1.0"),
    "hu": ("provenance", "Human authorship", "3.0"),
}

SIGNALS: list[tuple[str, str, str, Decimal]] = [(s, _CATEGORIES[s[:2]][0], d, Decimal(w).quantize(Decimal("0.01"))) for s, d, w in (x.split() for x in _SIGNALS.split("\n") if x)]
CATEGORIES: list[tuple[str, str, Decimal | None]] = [(c, label, Decimal(cap) if cap else None) for c, label, cap in _CATEGORIES.values()]


def signals(spark: SparkSession) -> DataFrame:
    """(signal_id, category, direction, weight): a fixed table of some hundred rows."""
    return spark.createDataFrame(SIGNALS, "signal_id string, category string, direction string, weight decimal(4,2)")


def categories(spark: SparkSession) -> DataFrame:
    """(category, category_label, cap); cap is null where the sum isn't limited."""
    return spark.createDataFrame(CATEGORIES, "category string, category_label string, cap decimal(3,1)")


def strength(weight: Column) -> Column:
    w = F.abs(weight)
    return F.when(w >= 3, "decisive").when(w >= 0.95, "strong").when(w >= 0.55, "moderate").otherwise("weak")


def by_category(spark: SparkSession) -> DataFrame:
    """The catalogue with each signal's strength and its place in its category, heaviest first."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("weight"), "signal_id"))
    return signals(spark).select("signal_id", "category", "direction", "weight", strength(F.col("weight")).alias("strength"), place.alias("place"))


def values_sql() -> str:
    """The catalogue as a SQL relation, for the queries' SQL."""
    rows = ", ".join(f"('{s}', '{c}', '{d}', {w})" for s, c, d, w in SIGNALS)
    return f"(SELECT c.signal_id, c.category, c.direction, c.weight::DECIMAL(4,2) AS weight FROM (VALUES {rows}) c(signal_id, category, direction, weight))"


def caps_sql() -> str:
    rows = ", ".join(f"('{c}', {cap or 'NULL'})" for c, _, cap in CATEGORIES)
    return f"(SELECT c.category, c.cap::DECIMAL(3,1) AS cap FROM (VALUES {rows}) c(category, cap))"
