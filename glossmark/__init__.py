"""Reference-free quality assessment of translated text, as PySpark DataFrame plans."""
