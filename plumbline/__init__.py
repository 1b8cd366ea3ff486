"""plumbline: a Spark-first engine for text-quality rules, candidate maths and corpus statistics."""
