"""Readers and writers: catalogue files, stored files, web pages, dossiers, versioned tables."""
