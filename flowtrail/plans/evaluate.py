"""Evaluation and export plans over a detection run."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtrail.operators import boosting, cases, compare, graph, queue, ranker, rules, scoring, slices, traversal
from flowtrail.params import CONTEXT_HOPS, TOP_RINGS
from flowtrail.plans.detect import Detection
from flowtrail.session import stage
from flowtrail.sources.tables import write_bundle


@dataclass
class CaseBook:
    """Views of the top rings of a detection run."""

    run: Detection
    top_k: int = TOP_RINGS
    hops: int = CONTEXT_HOPS

    @cached_property
    def selected(self) -> DataFrame:
        """Written, so that the size of these few rings is known to every join that reads them."""
        return stage(queue.head(self.run.ranked, self.run.candidates, self.top_k, self.run.params), "selected")

    @cached_property
    def internal(self) -> DataFrame:
        return stage(
            cases.internal_transfers(self.selected, self.run.search, self.run.edges, few=True), "internal"
        )

    @cached_property
    def roles(self) -> DataFrame:
        return stage(
            cases.classify_roles(
                self.selected, self.internal, queue.cross_ring_counts(self.run.ranked, among=scoring.memberships(self.selected))
            ),
            "roles",
        )

    @cached_property
    def investigation(self) -> DataFrame:
        return cases.investigate(self.selected, self.internal)

    @cached_property
    def flagged(self) -> DataFrame:
        return slices.account_roles(self.roles)

    @cached_property
    def links(self) -> DataFrame:
        flagged = stage(self.flagged.select("node"), "flagged")
        context = slices.context_accounts(self.run.pairs, self.run.accounts, flagged, self.hops)
        # Written too: quiet neighbours of few accounts.
        kept = stage(context.unionByName(flagged), "slice-accounts")
        return stage(slices.slice_links(self.run.search, kept), "slice-links")

    @cached_property
    def nodes(self) -> DataFrame:
        return slices.slice_nodes(self.links, self.flagged)


@dataclass
class Evaluation:
    run: Detection

    @cached_property
    def rule_profile(self) -> DataFrame:
        return stage(rules.rule_profile(self.run.transfers), "rule-profile")

    @cached_property
    def rule_totals(self) -> DataFrame:
        return rules.rule_evaluation(self.rule_profile)

    @cached_property
    def depths(self) -> DataFrame:
        labels = stage(compare.pair_labels(self.run.transfers), "pair-labels")
        return compare.pair_depth(labels, self.run.ranked)

    @cached_property
    def depth_histogram(self) -> DataFrame:
        """What every depth, the full queue, the summary and the deltas are read from."""
        return stage(compare.depth_histogram(self.depths), "depth-histogram")

    @cached_property
    def comparison(self) -> DataFrame:
        return compare.compare(self.depth_histogram, self.rule_totals, self.run.ranked)

    @cached_property
    def predicted(self) -> DataFrame:
        return scoring.memberships(self.run.ranked)

    @cached_property
    def graph_nodes(self) -> DataFrame:
        return stage(graph.node_table(self.run.transfers), "graph-nodes")

    @cached_property
    def graph_seed(self) -> int:
        return traversal.telling_seed(self.graph_nodes)

    @cached_property
    def graph_links(self) -> DataFrame:
        return stage(traversal.account_links(self.run.transfers, self.graph_seed), "graph-links")

    @cached_property
    def members(self) -> DataFrame:
        """Components by number; their sizes need no names and no account."""
        found = traversal.contracted_components(self.graph_links.select("u", "v"))
        return traversal.component_members(self.graph_nodes, self.graph_seed, found)

    @cached_property
    def components(self) -> DataFrame:
        return traversal.named_components(stage(self.members, "component-members"))

    @cached_property
    def graph_stats(self) -> DataFrame:
        return graph.graph_stats(self.graph_nodes, self.graph_links, self.members, "ways")


def ranking_candidates(run: Detection) -> DataFrame:
    """What the ranker orders: the candidates that may enter the queue."""
    return run.candidates.where(F.size("accounts") <= run.params.max_ring_accounts)


def training(run: Detection, splits: int) -> DataFrame:
    return ranker.training_table(ranking_candidates(run), scoring.ring_accounts(run.transfers), splits)


@dataclass
class Ranking:
    """The learned order of a run's candidates."""

    run: Detection
    params: ranker.RankerParams = ranker.RankerParams()

    @cached_property
    def training(self) -> DataFrame:
        return stage(training(self.run, self.params.splits), "training")

    @cached_property
    def forest(self) -> boosting.Forest:
        """Fitted once; every query of a session that needs a model uses this one."""
        return ranker.fit(self.training, self.params)

    @cached_property
    def scored(self) -> DataFrame:
        return ranker.train_and_score(self.training, self.params, self.forest)

    def sections(self, top_k: int) -> dict[str, DataFrame]:
        return {
            "ranking": ranker.learned_queue(self.scored, self.run.ranked, top_k),
            "ranking_metrics": ranker.held_out_precision(self.scored, self.params),
            "ranking_coverage": ranker.coverage_summary(self.training, self.params.splits),
        }


def bundle_sections(book: CaseBook, evaluation: Evaluation, ranking: Ranking) -> dict[str, DataFrame]:
    """The findings, one table per section."""
    totals = cases.scan_totals(book.selected, book.run.ranked)
    return {
        "scan": cases.scan_rings(book.selected, book.internal),
        "scan_totals": totals,
        "traced": cases.traced_totals(book.internal),
        "cards": cases.ring_cards(book.selected, book.internal, book.roles),
        "graph_nodes": book.nodes,
        "graph_links": book.links,
        "rules": rules.per_rule(evaluation.rule_profile),
        "rule_totals": evaluation.rule_totals,
        "headline": compare.headline(evaluation.rule_totals, totals),
        "benchmark": evaluation.comparison,
        "benchmark_summary": compare.comparison_summary(
            evaluation.comparison, evaluation.rule_totals, book.run.ranked
        ),
        "detail": book.investigation,
        "roles": book.roles,
        **ranking.sections(book.top_k),
    }


def export(book: CaseBook, evaluation: Evaluation, ranking: Ranking, folder: str) -> None:
    write_bundle(bundle_sections(book, evaluation, ranking), folder)
