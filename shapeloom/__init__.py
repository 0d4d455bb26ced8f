"""Knowledge-graph profiling and shape mining on Spark."""
