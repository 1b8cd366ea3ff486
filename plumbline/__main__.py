"""``python -m plumbline``: a run, or one prompt, by a settings file and the command line."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from plumbline import generate
from plumbline.config import from_arguments


def main(arguments: list[str] | None = None) -> int:
    config, prompt = from_arguments(arguments)
    spark = SparkSession.builder.appName("plumbline").getOrCreate()
    spark.sparkContext.setLogLevel({"WARNING": "WARN", "CRITICAL": "FATAL"}.get(config.logging_level, config.logging_level))
    if prompt is not None:
        told = lambda _, event: print(f"banned {event['type']}: {event['details']['suppression_detail_key']}", file=sys.stderr)
        found = generate.one(prompt, config, generate.rules_of(spark, config), generate.provider_of(config)(), told)
        print(found["text"])
        return 0 if found["error"] is None else 1
    told = lambda p: print(f"wave {p['wave']}: {p['prompts']} prompts, {p['tokens']} tokens, banned {p['events']}", file=sys.stderr)
    generate.run(spark, config, progress=told).show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
