"""Tables, documents and web pages to answers, as Spark jobs."""
