"""Code-fact analytics on PySpark: facts are tables, questions are DataFrame plans."""
