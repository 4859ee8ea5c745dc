"""The engine as one object: scan a tree, then ask for facts, patterns, risks, gates and differences."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog
from .operators import drilldown, entrypoints, evidence, extract, gate, graph, linking, modules, patterns, prefix, reports, risks, rules, surface, walk
from .operators.evidence import Budget
from .sources import files as sources
from .storage import materialize, union_all


@dataclass
class Scan:
    """What a scan found.  What the detectors gave, and what several reports start from, is a table in the shared folder.

    files are those scanned, findings have their evidence's id, walked says of every file seen why it was skipped, if it
    was, and found is what the detectors gave before the limit on findings.
    """

    files: DataFrame
    findings: DataFrame
    walked: DataFrame
    found: DataFrame
    budget: Budget = field(default_factory=Budget)

    @property
    def _all_events(self) -> DataFrame:
        kinds = [k for k in graph.NODE_TYPES if k.split(".")[0] in ("api", "db", "queue", "cache")]
        return self.findings.where(F.col("kind").isin(kinds)).withColumn("event_id", F.col("fid")).withColumn("queue_name", F.col("name"))

    @property
    def events(self) -> DataFrame:
        """Finds of event kinds as events of their path; the first of them where the budget cuts."""
        rows = self._all_events
        return rows if self.budget.max_events is None else rows.orderBy("path", "start_line", "event_id").limit(self.budget.max_events)

    @functools.cached_property
    def _evidence(self) -> DataFrame:
        return materialize(evidence.evidence_of(self.findings, self.files, self.budget), "evidence")

    @functools.cached_property
    def _surface(self) -> DataFrame:
        # only finds that lack a method or a route are looked up in their files
        bare = self.findings.where("concept = 'API' and (coalesce(method, '') = '' or coalesce(route, '') = '')")
        snippets = evidence.evidence_of(bare, self.files, self.budget).select(F.col("eid").alias("primary_eid"), "snippet")
        return materialize(surface.endpoints(self.findings.join(snippets, "primary_eid", "left")), "surface")

    @functools.cached_property
    def _api_links(self) -> DataFrame:
        return materialize(linking.links(surface.callers(self.findings), self._answering), "api-links")

    @functools.cached_property
    def _answering(self) -> DataFrame:
        """Endpoints as callers reach them: below the prefix that another file mounts their router at."""
        lines = extract.lines_of(self.files.where(F.col("path").rlike(r"\.[mc]?tsx?$")))
        return materialize(modules.with_prefixes(self._surface, modules.mounted(lines, self.files)), "answering")

    def evidence(self) -> DataFrame:
        """Places of the findings, with their lines."""
        return self._evidence

    def links(self) -> DataFrame:
        return evidence.links(self.findings)

    @functools.cached_property
    def placed(self) -> DataFrame:
        """Finds with the nodes that they stand for."""
        return materialize(graph.placed(self.findings), "placed")

    def nodes(self) -> DataFrame:
        return graph.nodes(self.placed)

    def edges(self) -> DataFrame:
        return graph.edges(self.placed)

    def surface(self) -> DataFrame:
        """Endpoints of code and specifications."""
        return self._surface

    def mismatches(self) -> DataFrame:
        return surface.mismatches(self.surface())

    def api_links(self) -> DataFrame:
        """Callers with the endpoint that answers them."""
        return self._api_links

    def unmatched(self) -> DataFrame:
        """(side, id, file) of callers and endpoints that no link has."""
        told, calls, ends = self.api_links(), surface.callers(self.findings), self._answering
        left = calls.join(told.select("caller_id"), "caller_id", "left_anti").select(F.lit("caller").alias("side"), F.col("caller_id").alias("id"), "file")
        return left.union(ends.join(told.select("endpoint_id"), "endpoint_id", "left_anti").select(F.lit("endpoint").alias("side"), F.col("endpoint_id").alias("id"), "file"))

    @functools.cached_property
    def _patterns(self) -> DataFrame:
        ev = self.events
        snippets = self.evidence().select(F.col("eid").alias("primary_eid"), "snippet")
        hints = self.findings.join(snippets, "primary_eid", "left").select("path", F.concat_ws(" ", "rule_id", "snippet", "concept").alias("text"), F.col("concept"))
        apart = self.unmatched().groupBy().agg(F.count_if(F.col("side") == "caller").alias("callers"), F.count_if(F.col("side") == "endpoint").alias("endpoints"))
        found = union_all([
            patterns.transaction_missing(ev), patterns.db_write_outside_tx(ev), patterns.queue_without_consumer(ev.where("kind = 'queue.dispatch'"), ev.where("kind = 'queue.consume'")),
            patterns.write_without_guard(ev, hints), patterns.hot_write_path(ev, hints), patterns.cross_language_unmatched(apart),
        ]).distinct()
        return materialize(found, "patterns")

    def patterns(self) -> DataFrame:
        """All pattern rules; hints come from the findings of a path: their rule, snippet and concept."""
        return self._patterns.orderBy(F.desc(risks.severity_rank(F.col("severity"))), "pattern_type", "pattern_id")

    def risks(self, gate_status: str = "pass") -> DataFrame:
        """Patterns as risks, the most pressing first."""
        refs = F.size(F.split("support", ","))
        score = risks.score(F.col("severity"), F.col("status"), F.col("pattern_type"), refs, F.col("confidence"), F.lit(gate_status))
        items = self.patterns().withColumn("risk_id", F.col("pattern_id")).withColumn("priority_score", score)
        return risks.rank(items).orderBy(F.desc("priority_score"), "severity", "status", "risk_id")

    def _refs(self) -> DataFrame:
        """(target, path, start_line, end_line, confidence): the events that each pattern rests on."""
        named = self.patterns().select(F.col("pattern_id").alias("target"), F.explode(F.split("support", ",")).alias("event_id")).distinct()
        return named.join(self._all_events.select("event_id", "path", "start_line", "end_line", "confidence"), "event_id").drop("event_id")

    def drilldowns(self, gate_status: str = "pass", limits: drilldown.Limits = drilldown.Limits(), least: str = "medium", always: bool = False, most: int = 5) -> DataFrame:
        """Risks with what is to be read of the sources: (.., drilled, snippets, trace)."""
        items = self.risks(gate_status)
        rows = drilldown.with_packs(items, self._refs(), self.files.select("path", "content"), limits, least, always, most)
        return rows.orderBy(F.desc("priority_score"), "severity", "status", "risk_id")

    def entrypoints(self) -> DataFrame:
        """How the project is started, the surest first."""
        return entrypoints.find(self.files).orderBy(F.desc("confidence"), "kind", "title", "path")

    def sarif(self) -> DataFrame:
        f = self.findings.select("rule_id", F.coalesce("concept", "kind").alias("concept"), "path", "start_line", "end_line", risks.sarif_level(F.col("confidence")).alias("severity"), F.col("fid").alias("fp"))
        return reports.sarif(f)

    def verify(self, strict: bool = False) -> DataFrame:
        """Counts of every check of this scan's own integrity."""
        return evidence.verify(self.findings, self.evidence(), self.links(), self.nodes(), self.edges(), self.budget, strict)

    def metrics(self) -> DataFrame:
        """(metric, actual): what gates are put to."""
        walked = self.walked.agg(F.count("*").alias("n"), F.count("reason").alias("skipped"), F.count_if(F.col("reason") == "budget").alias("cut")).join(self.files.agg(F.count("*").alias("scanned")))
        n = lambda df, name: df.agg(F.count("*").alias(name))
        all_ = walked
        side = self.mismatches().agg(F.count_if(F.col("side") == "missing_in_spec").alias("only_code"), F.count_if(F.col("side") == "missing_in_code").alias("only_spec"))
        warned = n(self.findings.where("kind = 'parse_error'"), "warned")
        for more in (n(self.found, "n_found"), n(self.findings, "n_kept"), n(self.nodes(), "n_nodes"), n(self.edges(), "n_edges"), n(self._all_events, "n_events"), side, warned):
            all_ = all_.join(more)  # one row each
        events = self.budget.max_events
        told = {
            "artifacts_missing_count": F.lit(0), "budget_cut": F.col("cut") > 0, "findings_truncated": F.col("n_found") > F.col("n_kept"),
            "events_truncated": F.lit(False) if events is None else F.col("n_events") > events, "skipped_ratio": F.when(F.col("n") > 0, F.col("skipped") / F.col("n")).otherwise(0.0),
            "scanned_files_count": F.col("scanned"), "skipped_files_count": F.col("skipped"), "warnings_count": F.col("warned"), "api.missing_in_spec_count": F.col("only_code"),
            "api.missing_in_code_count": F.col("only_spec"), "events_count": F.col("n_nodes"), "graph_edges": F.col("n_edges"),
        }
        return all_.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("actual")) for k, v in told.items()])).alias("m")).select("m.*")

    def skipped_top(self, most: int = 3) -> DataFrame:
        """The commonest reasons to skip a file."""
        return self.walked.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(most)

    def gate(self, gate_rules: DataFrame) -> DataFrame:
        """Broken rules (metric, op, value, level): those that fail first, each by metric."""
        return gate.violations(self.metrics(), gate_rules).orderBy(F.when(F.col("level") == "fail", 0).otherwise(1), "metric", "level")

    def summary(self) -> DataFrame:
        """(part, name, n): languages, concepts, kinds, frameworks, patterns and risks by how often they occur."""
        count = lambda df, part, by: df.where(F.col(by).isNotNull()).groupBy(F.lit(part).alias("part"), F.col(by).alias("name")).agg(F.count("*").alias("n"))
        found = [count(self.findings, part, by) for part, by in (("language", "language"), ("concept", "concept"), ("kind", "kind"), ("framework", "framework"), ("level", "parse_level"))]
        return union_all([*found, count(self.patterns(), "pattern", "pattern_type"), count(self.entrypoints(), "entrypoint", "kind")]).orderBy("part", F.desc("n"), "name")

    def listing(self, entity: str) -> DataFrame:
        """concepts, findings, evidence, events or graph, as lists in order."""
        if entity == "concepts":
            return self.findings.groupBy("concept").agg(F.count("*").alias("n")).orderBy("concept")
        if entity == "findings":
            return self.findings.select("fid", "concept", "confidence").orderBy("fid")
        if entity == "evidence":
            return self.evidence().select("eid", "path", "start_line", "end_line").orderBy("eid")
        if entity == "events":
            return self.nodes().select("event_id", "type", "key")
        if entity == "graph":
            return self.nodes().agg(F.count("*").alias("nodes")).join(self.edges().agg(F.count("*").alias("edges")))
        raise ValueError(f"no such entity: {entity}")

    def explain(self, fid: str) -> DataFrame:
        """A finding with its evidence, and the node that it stands for."""
        one = self.placed.where(F.col("fid") == fid).select("fid", "rule_id", "concept", "confidence", "event_id", "type", "key", "primary_eid")
        return one.join(self.evidence().withColumnRenamed("eid", "primary_eid"), "primary_eid")

    def diff(self, base: Scan) -> DataFrame:
        """Findings of both scans by fid, with what became of their severity."""
        mine, its = (s.findings.select(F.col("fid").alias("fp"), risks.sarif_level(F.col("confidence")).alias("severity")).groupBy("fp").agg(F.max("severity").alias("severity")) for s in (self, base))
        return gate.baseline_diff(its, mine)

    def diff_graph(self, base: Scan) -> DataFrame:
        """(part, id, state): nodes and edges that were added, removed, or are in both scans."""

        def both(new: DataFrame, old: DataFrame, part: str, key: str) -> DataFrame:
            rows = new.select(key, F.lit(True).alias("n")).join(old.select(key, F.lit(True).alias("o")), key, "full_outer")
            state = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("unchanged")
            return rows.select(F.lit(part).alias("part"), F.col(key).alias("id"), state.alias("state"))

        return both(self.nodes(), base.nodes(), "event", "event_id").union(both(self.edges(), base.edges(), "edge", "edge_id")).orderBy("part", "state", "id")


class Engine:
    """Entry point: ``Engine(spark).scan(path)`` or ``Engine(spark).query(name, tables)``."""

    def __init__(self, spark: SparkSession, rule_set: Sequence[rules.ScanRule] = tuple(rules.DEFAULT_RULES), budget: Budget = Budget()):
        self.spark, self.rules, self.budget = spark, rule_set, budget

    def scan(self, root: str) -> Scan:
        return self.scan_files(sources.read_tree(self.spark, root, max_bytes=self.budget.max_file_bytes))

    def scan_zip(self, archives: str) -> Scan:
        members = sources.read_zips(self.spark, archives).where("reason is null")
        return self.scan_files(members.select("path", "content", "size", F.sha2("content", 256).alias("sha256")))

    def scan_files(self, files: DataFrame, base: Scan | None = None) -> Scan:
        """Findings of files; those that base has with the same digest are taken from there."""
        b = self.budget
        walked = files.withColumn("reason", walk.skip_reason(F.col("path"), F.col("size"), F.col("content"), max_bytes=b.max_file_bytes))
        kept = walked.where("reason is null").drop("reason")
        if b.max_files is not None or b.max_total_bytes is not None:
            # the first files by path, at most max_files of them, as far as their bytes go
            sizes = prefix.running(kept.select("path", "size"), [], ["path"], {"n": F.lit(1).cast("bigint"), "total": F.col("size")})
            within = sizes.where((F.col("n") <= (b.max_files if b.max_files is not None else 1 << 62)) & (F.col("total") <= (b.max_total_bytes if b.max_total_bytes is not None else 1 << 62)))
            names = within.select("path", F.lit(True).alias("in"))
            walked = walked.join(names, "path", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("in").isNull(), "budget"))).drop("in")
            kept = kept.join(names.select("path"), "path", "left_semi")
        if b.max_lines is not None:
            kept = kept.withColumn("content", F.substring_index("content", "\n", b.max_lines))
        # written once, in folders by the rules that see a file, so that each detector reads its own files alone
        # dealt by path first: few large input files would leave the parsing to few tasks
        kept = materialize(kept.repartition("path").withColumn("seen", rules.seen_by(F.col("path"), self.rules)), "files", "seen")
        if base is None:
            found = self._detect(kept)
        else:
            known = base.files.select("path", "sha256").distinct()
            same = kept.join(known, ["path", "sha256"], "left_semi")
            found = base.found.join(same.select("path").distinct(), "path", "left_semi").unionByName(self._detect(kept.join(known, ["path", "sha256"], "left_anti")))
        found = materialize(found, "found")
        order = ["path", "start_line", "rule_id", "kind", "fid"]
        findings = found if b.max_findings is None else materialize(found.orderBy(*order).limit(b.max_findings), "findings")
        return Scan(kept.drop("seen"), findings, walked.select("path", "size", "reason"), found, b)

    def _detect(self, files: DataFrame) -> DataFrame:
        return evidence.with_ids(rules.detect(files.select("path", "content", "seen"), self.rules))

    def query(self, name: str, tables: str) -> DataFrame:
        """A registered query over a folder of tables."""
        return catalog.QUERIES[name](self.spark, tables)
