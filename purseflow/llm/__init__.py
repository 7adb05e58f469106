"""Training-data operators over corpora of documents and embeddings; nothing else imports this."""
