"""Find, report and remove leaked credentials in tables of text, on Spark."""
