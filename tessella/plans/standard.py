"""The standing report: its stages, from registered queries, and its sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella import catalogue
from tessella.plans import report
from tessella.plans.relations import ALPHA
from tessella.plans.runner import Stage
from tessella.plans.sections import Excerpt, Figure, Paragraph, Section

#: Tables by stage; each is the registered query of its name.
TABLES = {
    "data": ["join_coverage", "coverage_bias"],
    "quality": ["duplicate_report", "consistency_checks", "problematic_variables", "cleaning_effect"],
    "exploration": ["concentration_items", "spearman_popularity", "outlier_report"],
    "questions": ["q_m1", "q_m2", "q_m5", "q_m6", "q_a1", "q_a2"],
    "network": ["bipartite_invariants", "bipartite_density", "projection_verification"],
    "structure": ["item_topology", "component_sizes", "community_overview", "community_portrait"],
    "content": ["top_words", "label_distribution", "score_summary", "tone_and_likes"],
}


def stages() -> list[Stage]:
    """One stage a section; the network stops at a broken invariant."""
    broken = {"violations": F.coalesce(F.sum("violations"), F.lit(0))}
    watched = ("bipartite_invariants", "projection_verification")
    gates = {f"{t}_hold": (lambda m, t=t: m[t]["violations"]) for t in watched}
    return [
        Stage(name, {t: catalogue.QUERIES[t] for t in tables}, {t: broken for t in watched} if name == "network" else {}, gates if name == "network" else {})
        for name, tables in TABLES.items()
    ]


def _of(table: str, *columns: str, where: dict | None = None, **shown) -> dict[str, Figure]:
    """Figures named as their columns."""
    stage = next(s for s, ts in TABLES.items() if table in ts)
    return {c: Figure(f"{stage}/{table}", c, where or {}, shown.get(c, report.number)) for c in columns}


def _p(x: object) -> str:
    """A p-value; those that round to nothing are said to be small."""
    return "-" if x is None else "below 0.0001" if x < 1e-4 else f"{x:.4f}"


def _four(x: object) -> str:
    return report.number(x, 4)


def _renamed(figures: dict[str, Figure], suffix: str) -> dict[str, Figure]:
    return {f"{k}_{suffix}": f for k, f in figures.items()}


def sections() -> list[Section]:
    """Data, quality, exploration, questions, network, structure, content."""
    tone = lambda x: _of("label_distribution", "n", "pct", where={"label": x}, pct=report.percent)
    return [
        Section("Data and their integration", [
            Paragraph(
                "{fact_rows} participations name {fact_keys} items; the catalogue lists {catalog_keys}. {shared_keys} items are in both ({pct_observed} of the catalogue), {fact_only_keys} are unknown to the catalogue and {catalog_only_keys} were never taken part in.",
                _of("join_coverage", "fact_rows", "fact_keys", "catalog_keys", "shared_keys", "pct_observed", "fact_only_keys", "catalog_only_keys", pct_observed=report.percent),
            ),
            Paragraph(
                "Items with participation are seen differently from the rest: a median of {median_observed} views against {median_unobserved} (Mann-Whitney U {u}, p {p}).",
                _of("coverage_bias", "median_observed", "median_unobserved", "u", "p", p=_p), lambda v: v["p"] < ALPHA,
                "Items with participation are seen like the rest: a median of {median_observed} views against {median_unobserved} (Mann-Whitney U {u}, p {p}).",
            ),
        ]),
        Section("Quality, cleaning, preparation", [
            Paragraph("Of {n_rows} documents {n_duplicates} repeat the text of another.", _of("duplicate_report", "n_rows", "n_duplicates", where={"dataset": "documents", "by": "text"})),
            Paragraph("{violations} participations name an item that the catalogue lacks.", _of("consistency_checks", "violations", where={"check": "item known"})),
            Paragraph(
                "Cleaning leaves {tokens_after} of {tokens_before} tokens and takes {pct_tokens_removed} away; the median text goes from {median_tokens_before} to {median_tokens_after}. It holds {mentions} mentions, {hashtags} hashtags, {urls} links and {emojis} emoji; {empty_after} texts are empty afterwards.",
                _of("cleaning_effect", "tokens_after", "tokens_before", "pct_tokens_removed", "median_tokens_before", "median_tokens_after", "mentions", "hashtags", "urls", "emojis", "empty_after", pct_tokens_removed=report.percent),
            ),
            Excerpt("Checks", "quality/consistency_checks", ["check", "violations", "ok"], ["-violations", "check"], 20),
            Excerpt("Columns that need care", "quality/problematic_variables", ["dataset", "column", "problem", "evidence", "treatment"], ["dataset", "column"], 20),
        ]),
        Section("Exploration", [
            Paragraph(
                "Participation over {n} items has a Gini of {gini}: {units_for_50pct} items hold half of it, {units_for_80pct} hold four fifths, the first alone {top1_pct} and the first ten {top10_pct}.",
                _of("concentration_items", "n", "gini", "units_for_50pct", "units_for_80pct", "top1_pct", "top10_pct", gini=_four, top1_pct=report.percent, top10_pct=report.percent),
            ),
            Paragraph(
                "Views and participation go together over {n} items (rho {rho}, p {p}).", _of("spearman_popularity", "n", "rho", "p", rho=_four, p=_p), lambda v: v["p"] < ALPHA,
                "Views and participation don't go together over {n} items (rho {rho}, p {p}).",
            ),
            Paragraph("{n_iqr} of {n} likes ({pct_iqr}) lie beyond the fences {low} and {high}; by the robust score {n_robust} do.", _of("outlier_report", "n_iqr", "n", "pct_iqr", "low", "high", "n_robust", where={"variable": "likes"}, pct_iqr=report.percent)),
        ]),
        Section("Questions", [
            Paragraph("The source of most participations has {dominant_pct} of them.", _of("q_m6", "dominant_pct", dominant_pct=report.percent)),
            Paragraph("{multi_item} of {n_authors} authors take part in several items and {multi_channel} in several channels; {shared_pairs} pairs of items share authors, one pair {most_shared}.", _of("q_m2", "multi_item", "n_authors", "multi_channel", "shared_pairs", "most_shared")),
            Paragraph("Of {recurrent} authors who came back, {several_channels} cross channels ({pct_crossing}).", _of("q_a1", "recurrent", "several_channels", "pct_crossing", pct_crossing=report.percent)),
            Paragraph(
                "Likes go with the diversity of authors (rho {rho}, p {p}).", _of("q_a2", "rho", "p", where={"pair": "likes ~ n_authors"}, rho=_four, p=_p), lambda v: v["p"] < ALPHA,
                "Likes don't go with the diversity of authors (rho {rho}, p {p}).",
            ),
            Excerpt("Channels", "questions/q_m1", ["channel_id", "n_rows", "n_items", "n_authors", "pct"], ["-n_rows", "channel_id"], 5),
        ]),
        Section("Network and projections", [
            Paragraph("{authors} authors and {items} items are joined by {edges} edges, a density of {density}.", _of("bipartite_density", "authors", "items", "edges", "density", density=_four)),
            Excerpt("Invariants of the network", "network/bipartite_invariants", ["invariant", "violations"], ["invariant"], 20),
            Excerpt("Invariants of the projection", "network/projection_verification", ["check", "violations"], ["check"], 20),
        ]),
        Section("Topology, communities", [
            Paragraph(
                "The projection of {n} items has {m} edges, a density of {density} and a transitivity of {transitivity}; it falls into {components} components, of which the largest holds {giant} items ({pct_giant}), and {isolates} items stand alone.",
                _of("item_topology", "n", "m", "density", "transitivity", "components", "giant", "pct_giant", "isolates", density=_four, transitivity=_four, pct_giant=report.percent),
            ),
            Paragraph("{n_communities} communities, {n_singletons} of a single item, have a modularity of {modularity}.", _of("community_overview", "n_communities", "n_singletons", "modularity", modularity=_four)),
            Paragraph(
                "Tone depends on the community (chi-square {tone_chi2}, p {tone_p}, V {tone_v}).", _of("community_overview", "tone_chi2", "tone_p", "tone_v", tone_p=_p, tone_v=_four), lambda v: v["tone_p"] < ALPHA,
                "Nothing shows that tone depends on the community (chi-square {tone_chi2}, p {tone_p}, V {tone_v}).",
            ),
            Excerpt("Communities", "structure/community_portrait", ["community", "n_items", "n_rows", "n_authors", "top_terms", "n_scored", "net_polarity", "majority"], ["-n_rows", "community"]),
            Excerpt("Components", "structure/component_sizes", ["component", "size"], ["-size", "component"], 5),
        ]),
        Section("Content and tone", [
            Paragraph(
                "Of {n} texts {n_low_confidence} are scored with low confidence; the mean is {mean_confidence} and the net polarity {net_polarity}.",
                _of("score_summary", "n", "n_low_confidence", "mean_confidence", "net_polarity", mean_confidence=_four),
            ),
            Paragraph("{n_neg} texts are negative ({pct_neg}), {n_neu} neutral ({pct_neu}) and {n_pos} positive ({pct_pos}).", _renamed(tone("NEG"), "neg") | _renamed(tone("NEU"), "neu") | _renamed(tone("POS"), "pos")),
            Paragraph(
                "Likes differ by tone (H {h}, p {p}).", _of("tone_and_likes", "h", "p", p=_p), lambda v: v["p"] < ALPHA,
                "Likes don't differ by tone (H {h}, p {p}).",
            ),
            Excerpt("Words", "content/top_words", ["term", "frequency", "pct_total", "pct_documents"], ["-frequency", "term"]),
        ]),
    ]
