"""The SQL console."""

from __future__ import annotations

import re
import statistics
import sys
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame

from . import dialect
from .engine import Engine
from .printing import lines

HELP = """\
<SQL>                                run a statement
list                                 tables of the database
load <table> <csv> <separator> <null>  replace a table's rows with a file's
exec <file>                          run a script, those after a failed statement too
explain [<folder> <n> <n>] <query>   how Spark would run a query
bench <folder> <out>                 time all *.sql of a folder, as a TSV file
index all|keys                       statistics on all columns, or on keys
index <table> <column> ...           lay a table out in order of columns
compress                             nothing to do: Parquet has dictionaries
help                                 this text
quit                                 leave"""


class Console:
    def __init__(self, engine: Engine, out: Callable[[str], None] = print):
        self.engine, self.out = engine, out

    def run(self, line: str) -> bool:
        """Run a command or statement; False when it is time to leave."""
        line = line.strip().rstrip(";").strip()
        words = line.split()
        try:
            return self._run(line, words) if words else True
        except Exception as e:  # the console goes on
            self.out(f"Error: {e}")
            return True

    def _run(self, line: str, words: list[str]) -> bool:
        command = words[0].lower()
        if command == "quit":
            return False
        if command == "help":
            self.out(HELP)
        elif command == "list":
            for t in self.engine.database.tables():
                self.out(f"{t}({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in self.engine.database.schema(t))})")
        elif command == "load":
            if len(words) != 5:
                raise ValueError("load <table> <csv> <separator> <null>")
            self.engine.database.load_csv(*words[1:])
        elif command == "exec":
            self._script(Path(words[1]).read_text())
        elif command == "explain":
            # a folder and two numbers for plots may stand before the query; they change nothing
            plots = len(words) > 4 and words[2].isdigit() and words[3].isdigit()
            df = self.engine.query(line.split(None, 4 if plots else 1)[-1])
            self.out(df._jdf.queryExecution().toString())
        elif command == "bench":
            bench(self.engine, words[1], words[2])
        elif command == "index" and len(words) > 2:
            self.engine.database.sort(words[1], words[2:])
            self.out(f"{words[1].lower()} lies in order of {', '.join(words[2:])}")
        elif command == "index":
            self.out(f"statistics on {len(self.engine.database.analyze(keys_only=words[1:] == ['keys']))} tables")
        elif command == "compress":
            self.out("Parquet columns are dictionary-encoded already")
        else:
            self._script(line)
        return True

    def _script(self, sql: str) -> None:
        for _, result in self.engine.script(sql):
            if isinstance(result, Exception):
                self.out(f"Error: {result}")
            elif result is not None:
                for x in lines(result):
                    self.out(x)


def _phases(df: DataFrame) -> dict[str, float]:
    """Milliseconds that the planner took for each of its phases."""
    df._jdf.queryExecution().executedPlan()
    found, it = {}, df._jdf.queryExecution().tracker().phases().iterator()
    while it.hasNext():
        phase = it.next()
        found[phase._1()] = float(phase._2().durationMs())
    return found


def _counters(df: DataFrame) -> tuple[int, int, int]:
    """Joins, exchanges and rows read of the plan of a query that has run."""
    said = df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    return len(re.findall(r"Join(?:\s|LoopJoin)|CartesianProduct", said)), len(re.findall(r"(?<!Reused)Exchange[ (]", said)), _scanned(df._jdf.queryExecution().executedPlan())


def _scanned(node) -> int:
    """Rows that the scans below a node have given out."""
    metrics, n = node.metrics(), 0
    if "Scan" in node.nodeName() and metrics.contains("numOutputRows"):
        n = metrics.apply("numOutputRows").value()
    if node.nodeName() == "AdaptiveSparkPlan":
        return n + _scanned(node.executedPlan())
    below = [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(k) for k in range(node.children().size())]
    return n + sum(map(_scanned, below))


def bench(engine: Engine, folder: str, out: str, repeats: int = 1) -> None:
    """Time every query of a folder; several in a file get letters.

    Columns: the medians of all milliseconds and of those of parsing, analysis, optimisation,
    planning and execution, then result rows, joins, exchanges, and rows that scans read.
    """
    rows = ["query\tmillis\trows\tparsing\tanalysis\toptimization\tplanning\texecution\tjoins\texchanges\tscanned"]
    for path in sorted(Path(folder).glob("*.sql")):
        found = dialect.split_script(path.read_text())
        for k, sql in enumerate(found):
            name = path.stem + (chr(ord("a") + k) if len(found) > 1 else "")
            took, n, counts = [], 0, (0, 0, 0)
            for _ in range(repeats):
                began = time.perf_counter()
                df = engine.execute(sql)
                phases = dict.fromkeys(("parsing", "analysis", "optimization", "planning", "execution"), 0.0)
                if df is not None:
                    before = time.perf_counter()
                    counted = df.groupBy().count()
                    n = counted.collect()[0][0]
                    phases["execution"] = 1000 * (time.perf_counter() - before)
                    phases |= _phases(df)
                    counts = _counters(counted)
                took.append([1000 * (time.perf_counter() - began), *phases.values()])
            middle = [statistics.median(x) for x in zip(*took)]
            rows.append("\t".join([name, f"{middle[0]:.0f}", str(n), *(f"{x:.0f}" for x in middle[1:]), *map(str, counts)]))
    Path(out).write_text("\n".join(rows) + "\n")


def main() -> None:
    from .session import build_session

    console = Console(Engine(build_session("quern console")))
    for line in sys.stdin:
        if not console.run(line):
            break


if __name__ == "__main__":
    main()
