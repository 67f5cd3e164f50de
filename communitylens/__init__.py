"""communitylens: PySpark-native analytics over social-post communities."""
