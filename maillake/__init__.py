"""maillake: mail analytics and corpus operators expressed as Spark plans."""
