"""quillmesh: vector search, document text and corpus preparation as Spark jobs."""
