"""DataFrame -> DataFrame operators.  No actions, no collect, no Python UDFs
except the ML stages, which are Spark ML's own."""
