"""Column functions: every one takes and gives columns and stays in the JVM, but for those of text_python."""
