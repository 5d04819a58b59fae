"""Training-data operators over documents, embeddings and conversations.

Nothing else in the library imports this subpackage.
"""
