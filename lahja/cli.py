"""Command line over the library: ``python -m lahja.cli COMMAND``.

normalize, translit, segment, markers and detect work on text from the arguments or standard input; data (budget, fetch, build, train,
validate) on a cache of corpora; prompts, run, triage and report on files; train on two sets of files."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from . import storage
from .functions import markers, normalize, translit
from .operators import blocks, classifier, collect, corpus, report, sampling, segments
from .operators import triage as tr
from .session import session
from .sources import readers, registry

MIN_AUC, MIN_WORST = 0.85, 0.9


def _texts(spark, args):
    texts = args.text or [sys.stdin.read()]
    return spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").withColumn("n", normalize.normalize(F.col("text"), getattr(args, "level", "standard")))


def _print(df) -> int:
    for r in df.collect():
        print(json.dumps(r.asDict(recursive=True), ensure_ascii=False))
    return 0


def run(args, spark) -> int:
    t, n = F.col("text"), F.col("n")
    if args.command == "normalize":
        return _print(_texts(spark, args).select(n.alias("text")))
    if args.command == "translit":
        return _print(_texts(spark, args).select((translit.to_arabizi(t) if args.back else translit.to_arabic(t, args.qaf)).alias("text")))
    if args.command == "segment":
        return _print(segments.segments(_texts(spark, args), "id", "text").orderBy("id", "start"))
    if args.command == "markers":
        return _print(markers.find(_texts(spark, args), "id", "n").orderBy("id", "start"))
    if args.command == "detect":
        p = segments.profile(t)
        return _print(_texts(spark, args).select(normalize.script_ratio(t).alias("script"), F.round(translit.arabizi_score(t), 4).alias("arabizi"), p.alias("languages"), segments.is_code_switched(p).alias("code_switched"), markers.rates(n).alias("rates")))
    if args.command == "data":
        return data(args, spark)
    if args.command == "prompts":
        own = readers.read_prompts(spark, args.path)
        return _print(own.orderBy("id"))
    if args.command == "run":
        return campaign(args, spark)
    if args.command == "train":
        read = lambda paths, p: readers.read_text_lines(spark, " ".join(paths)).where("line <> ''").select(F.lit(p).alias("p"), F.col("line").alias("text"))
        own = read(args.positive, True).union(read(args.negative, False)).withColumn("h", F.md5("text"))
        train, test = own.where("h < 'c'"), own.where("h >= 'c'")
        model = classifier.train(train, "p", "text", tuple(args.labels))
        model.save(args.out)
        figures = classifier.evaluate(test, "p", "text", model).first().asDict()
        print(json.dumps(model.meta | figures, ensure_ascii=False))
        return int(figures["auc"] < MIN_AUC)
    model = classifier.Model.load(spark, args.model)
    scorer = tr.Scorer(model, classifier.Model.load(spark, args.arabizi_model) if args.arabizi_model else None)
    if args.command == "triage":
        docs = readers.read_documents(spark, args.path, args.field)
        if args.limit is not None:
            docs = docs.orderBy("pos").limit(args.limit)
        if args.group:
            docs = blocks.group_documents(docs.withColumn("all", F.lit(0)), "all", "pos", "text", args.group).select(F.col("unit").alias("id"), "text")
        verdicts = tr.triage(docs, "id", "text", scorer, args.strict)
        if args.out:
            verdicts.write.mode("overwrite").json(args.out)
        print(report.render(tr.triage_summary(verdicts), "Triage"))
        return 0
    replies = readers.read_replies(spark, args.path)
    verdicts = tr.reply_verdicts(replies, scorer).cache()
    print(report.render(report.cells(replies, verdicts, model.threshold).orderBy("model", "condition", "script"), "Cells"))
    print(report.render(report.paired_shifts(verdicts).orderBy("model"), "Paired shifts"))
    if args.prompts:
        print(report.render(report.by_register(verdicts, readers.read_prompts(spark, args.prompts)).orderBy("model", "condition", "category"), "Registers"))
    return 0


def data(args, spark) -> int:
    own = registry.sources(spark)
    if args.data == "budget":
        return _print(registry.budget(own)) or _print(registry.unlicensed(own).select("key", F.lit("no licence").alias("note")))
    if args.data == "fetch":
        wanted = args.only.split(",") if args.only else list(registry.SOURCES)
        if unknown := [k for k in wanted if k not in registry.SOURCES]:
            raise SystemExit(f"unknown sources: {unknown}")
        staged = lambda s: readers.read_source(spark, s, args.staged)
        meta = readers.fetch_all(spark, staged, [registry.SOURCES[k] for k in wanted], args.cache, force=args.force, max_lines=args.max_lines)
        _print(meta)
        return _print(readers.fetch_totals(meta)) or int(not meta.where("error is not null").isEmpty())
    if args.data == "list":
        have = readers.cached(spark, args.cache)
        return _print(registry.inventory(spark, have))
    if args.data == "validate":
        model = classifier.Model.load(spark, args.model)
        found = corpus.validate(readers.load_cache(spark, args.cache, own), model)
        print(report.render(found.orderBy("role", F.desc("median")), f"model {args.model}"))
        worst = report.worst_source(found, found.where("role = 'positive'"), MIN_WORST)
        return (_print(worst) or int(not worst.where("not passes").isEmpty())) if not worst.isEmpty() else 0
    c = registry.CONTRASTS[args.contrast]
    cache = readers.load_cache(spark, args.cache, own)
    side = lambda role, keys: cache.where((F.col("role") == role) & F.col("source").isin(*keys)) if keys else cache.where(F.col("role") == role)
    built = corpus.build(side("positive", c["positives"]), side("negative", c["negatives"]), c, ["line_no"], holdout=args.holdout, balance=not args.no_balance, seed=args.seed)
    built = storage.materialize(built, "built")
    _print(built.groupBy("cls", "split", "source").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n_words").alias("words")).orderBy("cls", "split", "source"))
    if args.data == "build":
        if args.out:
            built.write.mode("overwrite").parquet(args.out)
        return 0
    rows = built.select("split", (F.col("cls") == "positive").alias("p"), "text")
    model = classifier.train(rows.where("split = 'train'"), "p", "text", meta={"contrast": args.contrast})
    model.save(args.out or f"models/{args.contrast}.json.gz")
    figures = classifier.evaluate(rows.where("split = 'test'"), "p", "text", model).first().asDict()
    print(json.dumps(model.meta | figures, ensure_ascii=False))
    return int(figures["auc"] < MIN_AUC)


def campaign(args, spark) -> int:
    """Providers of this library are scripted ones (fake:NAME=TEXT); others are given by the caller of ``operators.collect``."""

    def build(spec: str):
        kind, _, rest = spec.partition(":")
        if kind != "fake":
            raise collect.ProviderError(f"no provider {kind!r} here")
        name, _, text = rest.partition("=")
        return collect.Scripted(name, [text or "..."])

    prompts = readers.read_prompts(spark, args.prompts)
    if args.sample:
        prompts = sampling.stratified(prompts, args.sample, args.seed)
    conditions = args.condition or list(collect.CONDITIONS)
    options = {"conditions": conditions, "resume": not args.no_resume, "limit": args.limit}
    if not args.yes:
        n = prompts.count() if args.limit is None else min(args.limit, prompts.count())
        if input(f"{n * len(args.model) * len(conditions)} calls at most. Go on? [y/N] ").strip().lower() not in ("y", "yes"):
            return 1
    if args.target:
        print(json.dumps(collect.relay(spark, args.model, build, prompts, args.out, args.target, **options), ensure_ascii=False))
        return 0
    found = collect.collect(spark, [build(x) for x in args.model], prompts, args.out, **options)
    print(json.dumps({"calls": found.calls, "succeeded": found.succeeded, "abandoned": found.abandoned}, ensure_ascii=False))
    return int(bool(found.abandoned))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lahja", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("normalize", "translit", "segment", "markers", "detect"):
        p = sub.add_parser(name)
        p.add_argument("text", nargs="*")
        p.add_argument("--level", default="standard", choices=normalize.LEVELS)
        p.add_argument("--back", action="store_true", help="Arabic to Latin script")
        p.add_argument("--qaf", action="store_true", help="write g as qaf")
    d = sub.add_parser("data").add_subparsers(dest="data", required=True)
    for name in ("budget", "fetch", "list", "validate", "build", "train"):
        p = d.add_parser(name)
        p.add_argument("--cache", default="data/raw")
        if name == "fetch":
            p.add_argument("--only", help="keys, separated by commas")
            p.add_argument("--staged", default="data/staged", help="folder with a folder or file for each source; nothing is downloaded")
            p.add_argument("--max-lines", type=int)
            p.add_argument("--force", action="store_true")
        if name == "validate":
            p.add_argument("--model", required=True)
        if name in ("build", "train"):
            p.add_argument("--contrast", default="vs_moroccan_yt", choices=sorted(registry.CONTRASTS))
            p.add_argument("--no-balance", action="store_true")
            p.add_argument("--holdout", type=float, default=0.25)
            p.add_argument("--seed", type=int, default=0)
            p.add_argument("--out")
    p = sub.add_parser("prompts")
    p.add_argument("path")
    p = sub.add_parser("run")
    p.add_argument("--prompts", required=True)
    p.add_argument("--model", action="append", required=True)
    p.add_argument("--target", type=int, help="so many complete measures out of the models as a pool")
    p.add_argument("--out", default="replies.jsonl")
    p.add_argument("--condition", action="append", choices=sorted(collect.CONDITIONS))
    p.add_argument("--sample", type=int)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--limit", type=int, help="the first prompts only")
    p.add_argument("--no-resume", action="store_true")
    p.add_argument("--yes", action="store_true")
    p = sub.add_parser("train")
    p.add_argument("--positive", nargs="+", required=True)
    p.add_argument("--negative", nargs="+", required=True)
    p.add_argument("--labels", nargs=2, default=["positive", "negative"])
    p.add_argument("--out", required=True)
    for name in ("triage", "report"):
        p = sub.add_parser(name)
        p.add_argument("path")
        p.add_argument("--model", required=True)
        p.add_argument("--arabizi-model")
        p.add_argument("--field", default="text")
        p.add_argument("--strict", action="store_true")
        p.add_argument("--out")
        p.add_argument("--prompts")
        if name == "triage":
            p.add_argument("--limit", type=int, help="the first documents only")
            p.add_argument("--group", type=int, nargs="?", const=60, help="judge consecutive fragments in units of so many words")
    args = parser.parse_args(argv)
    return run(args, session())


if __name__ == "__main__":
    sys.exit(main())
