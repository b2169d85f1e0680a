"""Column helpers that keep the hot paths inside the JVM."""
