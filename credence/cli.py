"""Command line: python -m credence.cli --store DIR COMMAND ...

A store is a folder with ``log`` (a Parquet log, partitioned by topic) and ``config.json`` (the active topic). Commands
that write take the topic's lock: a file that only one process can create, so that no two of them give out the same
places in the log. Answers are JSON lines; ``lint`` ends with 1 if there are errors, and so does a rejected batch.
"""

from __future__ import annotations

import argparse
import json
import os
import re
import sys
import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import conflicts, guard, ingest, lineage, report, temporal
from .operators.revise import Command
from .plans import State
from .sources import append, read_batch, read_table
from .starschema import log_of


class Store:
    """A folder with the logs of all topics and the choice of one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @property
    def config(self) -> dict:
        at = f"{self.path}/config.json"
        if not os.path.exists(at):
            return {}
        with open(at, encoding="utf-8") as f:
            return json.load(f)

    def choose(self, topic: str) -> None:
        """Make a topic the active one; it needs no event yet."""
        os.makedirs(self.path, exist_ok=True)
        text = json.dumps(self.config | {"topic": topic})
        with open(f"{self.path}/config.json", "w", encoding="utf-8") as f:
            f.write(text)

    def topic(self, given: str | None) -> str:
        if topic := given or self.config.get("topic"):
            return topic
        raise ValueError("no active topic: name one, or choose it with init")

    def topics(self) -> list[str]:
        """All topics that have events."""
        at = f"{self.path}/log"
        return sorted(x.removeprefix("topic=") for x in os.listdir(at) if x.startswith("topic=")) if os.path.isdir(at) else []

    def log(self, topic: str) -> DataFrame:
        return read_table(self.spark, f"{self.path}/log", topic) if topic in self.topics() else log_of(self.spark)

    @contextmanager
    def lock(self, topic: str, wait: float = 60) -> Iterator[None]:
        """Held by one writer of a topic at a time; an error if another one doesn't let go in time."""
        os.makedirs(self.path, exist_ok=True)
        name, end = f"{self.path}/{topic}.lock", time.time() + wait
        while True:
            try:
                os.close(os.open(name, os.O_CREAT | os.O_EXCL))
                break
            except FileExistsError:
                if time.time() > end:
                    raise TimeoutError(f"{name} is held by another writer") from None
                time.sleep(0.1)
        try:
            yield
        finally:
            os.remove(name)

    def write(self, rows: DataFrame) -> None:
        append(rows, f"{self.path}/log")


def show(rows: DataFrame) -> None:
    """Rows as JSON lines, one at a time."""
    for line in rows.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
        print(line["j"])


def run_ingest(store: Store, topic: str, a: argparse.Namespace) -> int:
    batch = read_batch(store.spark, a.file)
    place = lambda e: (not e["place"].startswith("sources"), [int(x) for x in re.findall(r"\d+", e["place"])])
    errors = sorted(ingest.validate(batch).collect(), key=place)  # of one document
    if errors:
        for e in errors:
            print(f"{e['place']}: {e['message']}", file=sys.stderr)
        return 1
    with store.lock(topic):
        log = store.log(topic)
        first = (log.agg(F.max("seq")).first()[0] or 0) + 1
        run = a.run or f"run_{datetime.now(UTC).isoformat(timespec='seconds')}"
        store.write(ingest.events(batch, State(log), topic, run, first))
        show(store.log(topic).where(F.col("seq") >= first).groupBy("event").agg(F.count("*").alias("n")).orderBy("event"))
    return 0


#: (group, action) -> (arguments, rows of the command). Arguments: name, or --name with "!" if it is required.
WRITES = {
    ("source", "add"): (["uri", "--title", "--origin", "--authority:float", "--credibility"], lambda do, a: do.add_source(a.uri, title=a.title, origin=a.origin, authority=a.authority, credibility=a.credibility)),
    ("source", "discredit"): (["uri", "--reason!"], lambda do, a: do.discredit(a.uri, a.reason)),
    ("source", "recredit"): (["uri"], lambda do, a: do.recredit(a.uri)),
    ("claim", "promote"): (["claim", "--to", "--reason"], lambda do, a: do.promote(a.claim, a.to, a.reason)),
    ("claim", "status"): (["claim", "--to!", "--reason"], lambda do, a: do.change_status(a.claim, a.to, a.reason)),
    ("claim", "dispute"): (["claim", "--reason"], lambda do, a: do.change_status(a.claim, "disputed", a.reason)),
    ("claim", "retract"): (["claim", "--reason!", "--by"], lambda do, a: do.retract(a.claim, a.reason, a.by)),
    ("claim", "supersede"): (["claim", "new"], lambda do, a: do.supersede(a.claim, a.new)),
    ("claim", "recalibrate"): (["claim", "--score!:float", "--method!"], lambda do, a: do.recalibrate(a.claim, a.score, a.method)),
    ("claim", "rebuttal"): (["claim", "--condition!", "--evidence"], lambda do, a: do.trigger_rebuttal(a.claim, a.condition, a.evidence)),
    ("conflict", "link"): (["claim_a", "claim_b", "--type", "--note"], lambda do, a: do.link(a.claim_a, a.claim_b, a.type or "factual", a.note)),
    ("conflict", "resolve"): (["thread", "status", "--note"], lambda do, a: do.resolve_thread(a.thread, a.status, a.note)),
    ("invalidate", None): (["claim", "--cause!", "--to"], lambda do, a: do.invalidate(a.claim, a.cause, a.to or "retracted")),
}


def _as_of(state: State, a: argparse.Namespace) -> DataFrame:
    at = F.lit(a.date).cast("timestamp")
    return temporal.as_of_world(state, at) if a.world else temporal.as_of_system(state.log, at)


#: (group, action) -> (arguments, rows of the answer).
READS = {
    ("claim", "show"): (["claim"], lambda s, a: temporal.show(s).where(F.col("claim_id") == a.claim)),
    ("conflict", "detect"): ([], lambda s, a: conflicts.ranked(conflicts.detect(s))),
    ("conflict", "candidates"): (["--threshold:float", "--vectors"], lambda s, a: conflicts.fuzzy_ranked(conflicts.fuzzy(s, a.threshold, s.log.sparkSession.read.parquet(a.vectors) if a.vectors else None))),
    ("query", "as-of"): (["date", "--world?"], _as_of),
    ("query", "downstream"): (["source"], lambda s, a: lineage.downstream(s, a.source)[1]),
    ("query", "status"): (["status"], lambda s, a: temporal.by_status(s, a.status)),
    ("query", "revisions"): (["claim"], lambda s, a: temporal.revision_log(s, a.claim)),
    ("review-queue", None): ([], lambda s, a: guard.review_queue(s)),
}


def run_lint(state: State) -> int:
    found = guard.lint(state).orderBy("severity", "rule", "claim_a", "claim_b").toLocalIterator()
    n = {"error": 0, "warning": 0}
    for x in found:
        n[x["severity"]] += 1
        print(f"{x['severity']} {x['rule']} {x['claim_a']} {x['claim_b'] or ''} {x['message']}")
    print(f"{n['error']} errors, {n['warning']} warnings")
    return int(n["error"] > 0)


def run_report(state: State) -> int:
    for rows in (report.totals(state), report.status_counts(state), report.believed(state).select("line"), report.health(state)):
        show(rows)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="credence")
    top.add_argument("--store", default="credence-store", help="folder of the logs")
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--topic", help="instead of the active topic")
    common.add_argument("--run", help="agent run that events are attributed to")
    groups = top.add_subparsers(dest="group", required=True)
    groups.add_parser("init").add_argument("--topic", required=True)
    groups.add_parser("ingest", parents=[common]).add_argument("file")
    for name in ("topic", "topics", "lint", "report"):
        groups.add_parser(name, parents=[common])
    made: dict = {}
    for (group, action), (arguments, _) in (WRITES | READS).items():
        if action is None:
            leaf = groups.add_parser(group, parents=[common])
        else:
            if group not in made:
                made[group] = groups.add_parser(group).add_subparsers(dest="action", required=True)
            leaf = made[group].add_parser(action, parents=[common])
        for x in arguments:
            name, _, kind = x.partition(":")
            if name.endswith("?"):
                leaf.add_argument(name[:-1], action="store_true")
            elif name.startswith("--"):
                leaf.add_argument(name.rstrip("!"), required=name.endswith("!"), type=float if kind else str)
            else:
                leaf.add_argument(name)
    return top


def main(args: list[str], spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("credence").getOrCreate()
    store, key = Store(spark, a.store), (a.group, getattr(a, "action", None))
    try:
        if a.group == "init":
            store.choose(a.topic)
            return 0
        if a.group == "topics":
            print("\n".join(store.topics()))
            return 0
        topic = store.topic(a.topic)
        if a.group == "topic":
            print(topic)
            return 0
        if a.group == "ingest":
            return run_ingest(store, topic, a)
        if key in WRITES:
            with store.lock(topic):
                do = Command(store.log(topic), topic, a.run)
                store.write(WRITES[key][1](do, a))
                show(store.log(topic).where(F.col("seq") >= do.next_seq).select("seq", "event", "claim_id", "source_id", "to", "reason").orderBy("seq"))
            return 0
        state = State(store.log(topic))
        if a.group == "lint":
            return run_lint(state)
        if a.group == "report":
            return run_report(state.shared())
        show(READS[key][1](state, a))
        return 0
    except (ValueError, TimeoutError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
