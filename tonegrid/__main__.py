"""Command line: analyze, compare, tempo, onsets, batch over WAV files, and the result cache."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import layout, matching, report, spectral, temporal
from .sources import results, sinks, wav


def options() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tonegrid")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *paths: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        for p in paths:
            sub.add_argument(p)
        sub.add_argument("--output")
        sub.add_argument("--fft-size", type=int, default=2048)
        sub.add_argument("--hop-size", type=int, default=512)
        sub.add_argument("--profile", default="detailed", choices=sorted(report.PROFILES))
        return sub

    command("analyze", "path")
    command("batch", "path").add_argument("--pattern", default="*")
    command("compare", "file_a", "file_b")
    command("tempo", "path").add_argument("--show-beats", action="store_true")
    command("onsets", "path").add_argument("--format", default="text", choices=("json", "csv", "text"))
    command("cache-stats", "path")
    command("clear-cache", "path").add_argument("--confirm", action="store_true")
    return top


def _show(rows, output: str | None, most: int = 50) -> None:
    """Write results where ``output`` says, or print the first."""
    if output:
        sinks.write_json(rows, output)
    else:
        for r in sinks.json_row(rows).limit(most).collect():
            print(r["json"])


def _samples(spark: SparkSession, path: str, pattern: str = "*"):
    """(rate, samples) for each rate that the files have."""
    audio = report_errors(wav.read_audio(spark, path, pattern))
    rates = [r[0] for r in audio.where("error is null").select("sample_rate").distinct().collect()]
    for rate in sorted(rates):
        yield rate, wav.mono(audio.where(F.col("sample_rate") == rate)).drop("sample_rate")


def report_errors(audio):
    """Files that can't be read are reported, the others go on."""
    for r in audio.where("error is not null").select("path", "error").limit(100).collect():
        print(f"{r['path']}: {r['error']}")
    return audio


def main(args: list[str] | None = None) -> None:
    o = options().parse_args(args)
    spark = SparkSession.builder.appName("tonegrid").getOrCreate()
    if o.command == "cache-stats":
        results.stats(results.read_cache(spark, o.path)).show()
    elif o.command == "clear-cache":
        results.clear(spark, o.path) if o.confirm else print("Use --confirm to clear the cache")
    elif o.command == "compare":
        both = report_errors(wav.read_audio(spark, o.file_a).unionByName(wav.read_audio(spark, o.file_b)))
        rate = both.agg(F.max("sample_rate")).first()[0]
        rows = wav.mono(both).drop("sample_rate")
        crossed = layout.with_crossings(rows)
        spectra = spectral.stft(layout.frames_of(rows, o.fft_size, o.hop_size))
        ids = rows.select("signal_id").distinct()
        pairs = ids.select(F.min("signal_id").alias("id_a"), F.max("signal_id").alias("id_b"))
        _show(matching.compare(pairs, matching.Fingerprints.of(crossed, spectra, rate, o.fft_size, o.hop_size)).withColumnRenamed("id_a", "signal_id"), o.output)
    else:
        settings = report.Settings(o.fft_size, o.hop_size)
        for rate, rows in _samples(spark, o.path, getattr(o, "pattern", "*")):
            output = o.output and f"{o.output}/rate={rate}"
            if o.command in ("analyze", "batch"):
                record = report.analyze(rows, rate, o.profile, settings)
                record = report.with_insights(record) if o.profile == "detailed" else record
                sinks.write_each(record, output) if o.command == "batch" and output else _show(record, output)
                continue
            flux = spectral.flux(spectral.stft(layout.frames_of(rows, o.fft_size, o.hop_size)))
            onsets = temporal.onsets(flux, "flux_l2", o.hop_size, rate, first=1)
            if o.command == "onsets" and o.format == "csv" and output:
                sinks.write_onsets(onsets, output)
            elif o.command == "onsets":
                _show(onsets.groupBy("signal_id").agg(layout.ordered("onsets", "idx", F.col("t"))), output)
            else:
                grid = temporal.beats(onsets, temporal.tempo(onsets))
                shown = grid.join(temporal.stability(grid), "signal_id").withColumn("tempo", 60.0 / F.col("period"))
                beats = ["tempo_stability"] + ([F.slice("beats", 1, 20).alias("beats")] if o.show_beats else [])
                _show(shown.select("signal_id", "tempo", *beats), output)


if __name__ == "__main__":
    main()
