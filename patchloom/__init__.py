"""PySpark jobs that build, curate and grade code-change benchmarks."""
