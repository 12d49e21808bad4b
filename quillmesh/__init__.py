"""quillmesh: entity matching and batch analytics on PySpark."""
