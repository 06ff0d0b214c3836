"""Command line: python -m lodestone.plans.cli COMMAND. Commands that check return 1 where something is wrong."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Command -> help, positional arguments, options (name, type, default; None: needed).
COMMANDS = {
    "list": ("names of the queries", [], []),
    "run": ("run a query over a folder of tables", ["query"], [("sf", str, None), ("output", str, "")]),
    "build": ("build or resume a corpus from documents", ["source", "folder"], [("target", int, None)]),
    "status": ("tokens a build has written against its target", ["folder"], [("target", int, None)]),
    "audit": ("capacity of each source", ["documents"], [("tokenizer", str, ""), ("output", str, "")]),
    "merge": ("allocation of a plan from audit reports", ["plan", "reports"], [("output", str, "")]),
    "verify": ("check token shards against their manifest", ["folder"], []),
    "sft": ("records of tool dialogs made of conversations", ["conversations"], [("rounds", int, 3), ("quota", int, 1000), ("context", int, 2048), ("tokenizer", str, ""), ("allow_short", int, 0), ("output", str, "")]),
    "preflight": ("check a configuration and the shards it asks for", ["config", "folder"], []),
    "matrix": ("whether the runs of each tier cost the same", ["results"], [("tolerance", float, 0.05)]),
    "report": ("best runs of each tier as Markdown", ["results"], [("output", str, None)]),
    "stream": ("one session of a build that reads JSON lines and ends in partials of token shards", ["lines", "folder"], [("target", int, None), ("batch_bytes", int, 64 << 20), ("seconds", float, 0.0), ("suffix", str, ".jsonl")]),
    "shards": ("exact token shards of all committed partials", ["folder"], [("shard_tokens", int, None), ("vocabulary", int, 1 << 16)]),
    "assemble": ("one corpus of the shards of several builds, each source in proportion", ["sources", "target"], []),
    "validation": ("documents of the validation part that pass all checks", ["documents"], [("fraction", float, 0.05), ("output", str, "")]),
    "analyze": ("best runs, costs and the fitted law of a study as Markdown", ["results"], [("output", str, None)]),
    "export": ("metric logs of runs as a dashboard's files", ["root", "folder"], []),
}
RUNS = "run string, tier string, parameters long, tokens long, loss double"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    commands = p.add_subparsers(dest="command", required=True)
    for name, (about, places, options) in COMMANDS.items():
        one = commands.add_parser(name, help=about)
        for place in places:
            one.add_argument(place)
        for option, kind, default in options:
            one.add_argument(f"--{option}", type=kind, required=default is None, default=default)
    return p


def _shown(df: DataFrame, folder: str) -> int:
    df.write.json(folder) if folder else df.show(200, truncate=False)
    return 0


def _told(**what) -> int:
    print(json.dumps(what, sort_keys=True))
    return 0 if all(v for v in what.values() if isinstance(v, bool)) else 1


class Commands:
    """One method for each command."""

    def __init__(self, args: argparse.Namespace):
        self.args = args

    @property
    def spark(self) -> SparkSession:
        return SparkSession.builder.appName("lodestone").getOrCreate()

    def list(self) -> int:
        from lodestone.queries import QUERIES

        print("\n".join(QUERIES))
        return 0

    def run(self) -> int:
        from lodestone.queries import QUERIES

        df = QUERIES[self.args.query](self.spark, self.args.sf)
        df.write.parquet(self.args.output) if self.args.output else df.show(40, truncate=80)
        return 0

    def build(self) -> int:
        from lodestone.streaming.build import build

        done = build(self.spark, self.args.source, self.spark.read.parquet(self.args.source).schema, self.args.folder, self.args.target)
        return _shown(done.groupBy("source").agg(F.sum("kept").alias("tokens")), "")

    def status(self) -> int:
        from lodestone.streaming.build import committed

        have = committed(self.spark, self.args.folder).groupBy("source").agg(F.sum("kept").alias("tokens"))
        return _shown(have.withColumn("complete", F.col("tokens") >= self.args.target), "")

    def audit(self) -> int:
        from lodestone.functions.text import whitespace_tokens
        from lodestone.functions.tokenizers import token_count
        from lodestone.operators.audit import capacity_audit

        count = token_count(self.args.tokenizer) if self.args.tokenizer else whitespace_tokens
        return _shown(capacity_audit(self.spark.read.parquet(self.args.documents), tokens=count), self.args.output)

    def merge(self) -> int:
        from lodestone.operators.audit import cap_and_fill, merge_reports
        from lodestone.sources import files

        plan = files.read_object(self.args.plan)
        rows = [(i, s["source"], float(s["weight"]), bool(s.get("finite")), s.get("fill")) for i, s in enumerate(plan["sources"])]
        config = self.spark.createDataFrame(rows, "pos int, source string, weight double, finite boolean, fill double")
        reports = self.spark.read.json(self.args.reports).select("source", F.lit("complete").alias("status"), F.lit("").alias("config_sha"), F.col("tokens_after").alias("usable"))
        return _shown(cap_and_fill(merge_reports(config, reports, ""), int(plan["train_tokens"])), self.args.output)

    def verify(self) -> int:
        from lodestone.sources.shards import verify_shards

        bad = verify_shards(self.spark, self.args.folder).where("NOT ok").collect()
        return _told(ok=not bad, bad=[r.file for r in bad])

    def sft(self) -> int:
        from lodestone.operators import dialogs

        seeds = dialogs.synthetic_seeds(self.spark, self.spark.read.parquet(self.args.conversations))
        made = dialogs.candidates(seeds, self.args.rounds, context=self.args.context, tokenizer=self.args.tokenizer or None)
        return _shown(dialogs.accepted_records(made, self.args.quota, allow_short=bool(self.args.allow_short)), self.args.output)

    def preflight(self) -> int:
        from lodestone.operators import config
        from lodestone.sources import files
        from lodestone.sources.shards import verify_shards

        said = files.read_object(self.args.config)
        try:
            config.validate(said)
            sound = True
        except config.ConfigError:
            sound = False
        told = files.read_object(f"{self.args.folder}/manifest.json")
        whole = verify_shards(self.spark, self.args.folder).where("NOT ok").isEmpty()
        return _told(config=sound, shards=whole and told["tokens"] >= int(said["train_tokens"]))

    def _runs(self) -> DataFrame:
        return self.spark.read.csv(self.args.results, header=True, schema=RUNS)

    def matrix(self) -> int:
        from lodestone.operators.audit import iso_flop_spread

        spread = iso_flop_spread(self._runs(), self.args.tolerance).collect()  # a row for each tier
        return _told(**{r.tier: bool(r.within) for r in spread})

    def report(self) -> int:
        from lodestone.operators.audit import best_runs
        from lodestone.sources import files, runs

        files.write(self.args.output, runs.markdown(best_runs(self._runs()).orderBy("tier"), "Best runs").encode())
        return 0

    def stream(self) -> int:
        from lodestone.streaming.shards import stream_session

        done = stream_session(self.spark, self.args.lines, self.args.folder, self.args.target, batch_bytes=self.args.batch_bytes, seconds=self.args.seconds or None, suffix=self.args.suffix)
        return _told(rows=done.rows, batches=len(done.batches))

    def shards(self) -> int:
        from lodestone.sources.shard_sink import assembled

        made = assembled(self.spark, self.args.folder, self.args.shard_tokens, self.args.vocabulary)
        return _told(**{source: sum(s["tokens"] for s in told) for source, told in made.items()})

    def assemble(self) -> int:
        from lodestone.operators.corpus import fair_shard_plan
        from lodestone.operators.ordered import global_position
        from lodestone.sources import files, shards

        folders = files.read_object(self.args.sources)
        rows = [(source, i, x["tokens"]) for source, folder in folders.items() for i, x in enumerate(files.read_object(f"{folder}/manifest.json")["shards"])]  # a row for each shard
        plan = fair_shard_plan(self.spark.createDataFrame(rows, "source string, shard long, tokens long"))
        placed = global_position(plan.select("source", "shard", "turn"), ["turn", "source", "shard"])
        done = shards.assemble(self.spark, folders, placed, self.args.target)
        return _told(shards=len(done), tokens=sum(x["tokens"] for x in done))

    def validation(self) -> int:
        from lodestone.operators import corpus

        docs = self.spark.read.parquet(self.args.documents)
        rows = docs if "license" in docs.columns else docs.withColumn("license", F.lit(None).cast("string"))
        told = corpus.rejection_reasons(rows, None, self.args.fraction, "validation")
        return _shown(told.where("reason IS NULL").select("source", "doc_id", "chars", "n_tokens"), self.args.output)

    def analyze(self) -> int:
        from lodestone.operators import audit
        from lodestone.sources import files, runs

        parts = {"Best runs": audit.best_runs(self._runs()).orderBy("tier"), "Costs": audit.iso_flop_spread(self._runs()).orderBy("tier"), "Fitted law": audit.scaling_fit(self._runs())}
        files.write(self.args.output, "\n".join(runs.markdown(table, title) for title, table in parts.items()).encode())
        return 0

    def export(self) -> int:
        from lodestone.sources.runs import export_dashboard, scan_metrics

        export_dashboard(scan_metrics(self.spark, self.args.root), self.args.folder)
        return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return getattr(Commands(args), args.command)()


if __name__ == "__main__":
    raise SystemExit(main())
