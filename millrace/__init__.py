"""millrace: event-stream and corpus analytics as composable DataFrame operators."""
