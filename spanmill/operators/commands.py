"""Command classification as a job: distinct texts, segments, dimension join, best activity per text.

The dimension is a parameter. The default holds common public programs; load a larger one as a
table ``(tool_id, activity, utility, runner)`` plus ``(tool_id, sub, activity)`` for subcommands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import script_activity
from ..skew import bounded

# Lower rank = more likely what the call was for.
ACTIVITY_RANK = ["build", "check", "test", "data", "cloud", "deps", "devices", "web", "run", "infra", "vcs", "edit",
                 "integration", "agent", "human", "other", "system", "explore"]

PROGRAMS = {
    "explore": "cat head tail less more grep rg ag fd find ls tree wc sort uniq cut diff file stat jq yq bat which type",
    "system": "echo printf cd pwd mkdir rm rmdir cp mv ln touch chmod chown ps kill sleep date env export set true false test tee tar zip unzip df du",
    "edit": "sed awk perl patch",
    "run": "node python python3 ruby php java deno tsx ts-node npm pnpm yarn bun make just uv poetry pipx npx bunx dotnet",
    "check": "eslint prettier tsc biome ruff black flake8 mypy pyright pylint shellcheck clippy golangci-lint rubocop stylelint",
    "build": "webpack vite rollup esbuild gcc g++ clang cmake ninja cargo go gradle mvn swift xcodebuild rustc javac",
    "test": "jest vitest pytest mocha playwright cypress rspec phpunit tox nox ctest karma ava",
    "vcs": "git gh hg svn jj glab",
    "deps": "pip pip3 apt apt-get brew gem bundle composer conda",
    "infra": "docker docker-compose podman kubectl helm terraform ansible vagrant nerdctl kind minikube",
    "cloud": "aws gcloud az vercel netlify heroku flyctl wrangler firebase pulumi",
    "data": "psql mysql sqlite3 redis-cli mongosh prisma drizzle-kit duckdb alembic",
    "web": "curl wget http ssh scp rsync ping nc dig",
    "devices": "adb emulator xcrun simctl fastlane",
}
UTILITIES = set((PROGRAMS["explore"] + " " + PROGRAMS["system"] + " sed awk perl").split())
SUBS = {
    "npm": {"install": "deps", "ci": "deps", "i": "deps", "test": "test", "publish": "cloud"},
    "pnpm": {"install": "deps", "add": "deps", "test": "test"},
    "yarn": {"install": "deps", "add": "deps", "test": "test"},
    "cargo": {"test": "test", "check": "check", "clippy": "check", "fmt": "check", "add": "deps", "run": "run"},
    "go": {"test": "test", "vet": "check", "fmt": "check", "mod": "deps", "run": "run", "get": "deps"},
    "uv": {"pip": "deps", "add": "deps", "sync": "deps"},
    "poetry": {"add": "deps", "install": "deps"},
    "dotnet": {"test": "test", "build": "build", "restore": "deps"},
    "gradle": {"test": "test", "check": "check"}, "mvn": {"test": "test", "verify": "check"},
    "swift": {"test": "test"},
}
# launchers whose next word is the program, and wrappers that are skipped (at most four in a row)
RUNNERS = r"^(npx|bunx|pnpm exec|pnpm dlx|yarn dlx|npm exec|uv run|poetry run|pipx run|python3? -m|bundle exec)((?:\s+-\S+)*)\s+(\S.*)$"
WRAPPERS = (r"^(?:(?:[A-Za-z_][A-Za-z0-9_]*=\S*|(?:sudo|env|time|nohup|nice|command|exec|builtin|xargs)(?:\s+-\S+)*"
            r"|timeout(?:\s+-\S+)*\s+\S+)\s+){1,4}")
SHELL_C = r"^\s*(?:[\w./-]*/)?(?:ba|z|da|k)?sh\s+-[a-z]*c\s+(['\"])(.*)\1\s*$"
QUOTED = r"\"[^\"]*\"|'[^']*'"


def tool_dim(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{p}', '{a}', {str(p in UTILITIES).lower()})" for a, names in PROGRAMS.items() for p in names.split())
    return spark.sql(f"select * from values {rows} as v(tool_id, activity, utility)")


def sub_dim(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{p}', '{s}', '{a}')" for p, m in SUBS.items() for s, a in m.items())
    return spark.sql(f"select * from values {rows} as v(tool_id, sub, activity)")


def segments(command: Column) -> Column:
    """Simple commands of a command line: shells opened (two deep), quotes kept whole, wrappers dropped."""
    inner = command
    for _ in range(2):
        inner = F.regexp_replace(inner, "(?s)" + SHELL_C, "$2")
    flat = F.regexp_replace(inner, QUOTED, "QUOTED")
    parts = F.filter(F.transform(F.split(flat, r"\|\||&&|;|\||&|\n"), lambda s: F.trim(s)), lambda s: s != "")
    return F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, r"^[({!\s]+", ""), WRAPPERS, ""))


def classify_commands(commands: DataFrame, col: str = "command", tools: DataFrame | None = None,
                      subs: DataFrame | None = None, also_limit: int | None = None) -> DataFrame:
    """One row per distinct command: primary tool, sub, runner, activity and the tools it also ran.

    Primary = best activity rank, earliest on ties; also-ran = the others (``also_limit`` of them, all by default) in order of
    appearance, without search and file utilities.
    """
    spark = commands.sparkSession
    tools = tools if tools is not None else tool_dim(spark)
    subs = subs if subs is not None else sub_dim(spark)
    d = commands.select(F.col(col).alias("command")).filter("command is not null").distinct()
    s = d.select("command", F.posexplode(segments(F.col("command"))).alias("pos", "seg"))
    run = F.regexp_extract("seg", RUNNERS, 1)
    s = s.select("command", "pos", F.nullif(run, F.lit("")).alias("via"),
                 F.when(run != "", F.regexp_extract("seg", RUNNERS, 3)).otherwise(F.col("seg")).alias("seg"))
    w = F.split("seg", r"\s+")
    prog = F.regexp_replace(F.substring_index(F.translate(w[0], "\\", "/"), "/", -1), r"\.(exe|cmd|bat)$", "")
    words = F.filter(F.slice(w, 2, F.size(w)), lambda x: ~x.startswith("-"))
    s = s.select("command", "pos", "via", prog.alias("tool_id"), F.try_element_at(words, F.lit(1)).alias("sub"),
                 F.try_element_at(words, F.lit(2)).alias("arg"))
    script = F.when(F.col("tool_id").isin("npm", "pnpm", "yarn", "bun") & (F.col("sub") == "run"), F.col("arg")).when(
        F.col("tool_id").isin("make", "just") & F.col("sub").isNotNull(), F.col("sub"))
    s = s.withColumn("script", script)
    s = s.join(bounded(tools.withColumnRenamed("activity", "t_act")), "tool_id", "left").join(
        bounded(subs.withColumnRenamed("activity", "s_act")), ["tool_id", "sub"], "left")
    known = F.col("t_act").isNotNull()
    s = s.withColumn("act", F.when(F.col("script").isNotNull(), script_activity("script")).otherwise(
        F.coalesce("s_act", "t_act", F.lit("other"))))
    rank = F.array_position(F.array(*[F.lit(a) for a in ACTIVITY_RANK]), F.col("act"))
    pick = F.struct(F.when(known, F.col("tool_id")).alias("tool_id"), F.when(F.col("s_act").isNotNull() | F.col("script").isNotNull(), F.col("sub")).alias("sub"),
                    "via", "act", F.when(~known, F.col("tool_id")).alias("program"), "script")
    side = known & ~F.col("act").isin("explore", "system")
    g = s.groupBy("command").agg(
        F.min_by(pick, F.struct(rank, "pos")).alias("p"),
        F.array_sort(F.collect_list(F.when(side, F.struct("pos", "tool_id")))).alias("all"))
    also = F.filter(F.array_distinct(F.transform("all", lambda x: x["tool_id"])),
                    lambda x: F.col("p.tool_id").isNull() | (x != F.col("p.tool_id")))
    return g.select("command", "p.tool_id", F.col("p.sub").alias("tool_sub"), F.col("p.via").alias("via"), F.col("p.act").alias("activity"),
                    (also if also_limit is None else F.slice(also, 1, also_limit)).alias("tools_also"), "p.program", "p.script")


def with_command_tools(spans: DataFrame, command_col: str = "command", **kw) -> DataFrame:
    """Join the classification back on the command text's hash and text, then drop the text."""
    c = classify_commands(spans, command_col, **kw)
    keep = [x for x in spans.columns if x not in (command_col, "tool_id", "tool_sub", "activity", "tools_also")]
    j = spans.drop("tool_id", "tool_sub", "activity", "tools_also").join(
        c.withColumnRenamed("command", command_col).drop("program", "script", "via"), command_col, "left")
    return j.select(*keep, "tool_id", "tool_sub", "activity", "tools_also")


